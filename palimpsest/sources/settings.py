"""Settings from YAML files, sealed values, rule lists that are kept and reloaded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from ..functions.text import open_sealed, parse_duration
from .rules import BUILTIN, Config, Rule, RuleError, RuleList, clean_category, clean_pattern, parse_rules


def opener(spark: SparkSession, key: bytes) -> Callable[[str], str | None]:
    """For ConfigFile(opened=...): opens sealed values, leaves others, None for one that can't be opened."""

    def opened(value: str) -> str | None:
        return spark.range(1).select(open_sealed(F.lit(value), key)).first()[0]

    return opened


def rule_list_key(entry: dict) -> str:
    """What names a rule list: its id, else its path or address."""
    return (entry.get("id") or "").strip() or (entry.get("path") or "").strip() or (entry.get("url") or "").strip()


def config_of(data: dict, read: Callable[[str], str], opened: Callable[[str], str | None] = lambda value: value, project: bool = False) -> Config:
    """A Config from the tree of a settings file; a project's leaves what it doesn't set to the global one.

    read() gives a rule list file's text; opened() opens sealed keywords and excludes, None for one that
    can't be. Lists with one key and secret files of one format and path count once; empty patterns go.
    """
    patterns, session, proxy = data.get("patterns") or {}, data.get("session") or {}, data.get("proxy") or {}
    ner = patterns.get("ner") or {}
    values = lambda entries: [(v, e) for e in entries or [] if (v := opened(e["value"] if isinstance(e, dict) else e)) is not None]
    keywords = [(clean_pattern(v), clean_category(e.get("category") or "") or "TEXT") for v, e in values(patterns.get("keywords"))]
    own = [Rule("regex", clean_category(e.get("category") or "") or "REGEX", e["pattern"]) for e in patterns.get("regex") or [] if e.get("pattern")]
    own += [Rule("regex", *BUILTIN[name]) for name in patterns.get("builtin") or [] if name in BUILTIN]
    lists, seen = ([RuleList(own, "patterns")] if own else []), set()
    for entry in patterns.get("rule_lists") or []:
        key = rule_list_key(entry)
        if entry.get("enabled") and key and key not in seen and entry.get("path"):
            seen.add(key)
            lists.append(parse_rules(read(entry["path"]), key, entry.get("priority") or 0))
    return Config(
        [k for k in keywords if k[0]], [v for v, _ in values(patterns.get("exclude")) if v], lists, [t["host"].strip().lower() for t in data.get("targets") or [] if t.get("enabled") and t.get("host")],
        bool(ner.get("enabled")), list(ner.get("entities") or []), float(ner.get("min_score") or 0), proxy.get("intercept_mode") or "", bool(session.get("wal_enabled", True)), bool(session.get("deterministic_placeholders")),
        proxy.get("placeholder_prefix") or ("" if project else "__VG_"), parse_duration(str(session.get("ttl") or ""), 0 if project else 3600), int(session.get("max_mappings") or (0 if project else 100_000)),
    )


def secret_files(data: dict) -> list[dict]:
    """Enabled secret files, one for each format and path, with the format, category and least length that hold for them."""
    out: dict[tuple, dict] = {}
    for e in (data.get("patterns") or {}).get("secret_files") or []:
        style, path = (e.get("format") or "dotenv").strip().lower(), (e.get("path") or "").strip()
        if path and e.get("enabled", True) is not False:
            least = int(e.get("min_value_len") or 0)
            out.setdefault((style, path), {"format": style, "path": path, "category": clean_category(e.get("category") or "") or ("DOTENV" if style == "dotenv" else "SECRET_FILE"), "min_value_len": min(1024, least) if least > 0 else 8})
    return list(out.values())


class ConfigFile:
    """Settings of a global file and a project's; refresh() reads them again when their contents have changed."""

    def __init__(self, *paths: str | Path, opened: Callable[[str], str | None] = lambda value: value):
        self.paths, self.opened, self.seen, self.config = [Path(p) for p in paths], opened, None, Config()
        self.refresh()

    def refresh(self) -> bool:
        """Whether something changed; a file that can't be read or parsed leaves the settings as they were."""
        import yaml

        texts = [p.read_text() if p.exists() else "" for p in self.paths]
        now = hashlib.sha256("\0".join(texts).encode()).hexdigest()
        if now == self.seen:
            return False
        try:
            made = [config_of(yaml.safe_load(t) or {}, lambda name, p=p: (p.parent / name).read_text(), self.opened, k > 0) for k, (p, t) in enumerate(zip(self.paths, texts))]
        except (yaml.YAMLError, RuleError, OSError, TypeError, AttributeError, KeyError):
            if self.seen is None:
                raise
            return False
        self.seen, self.config = now, made[0]
        for project in made[1:]:
            self.config = self.config.merge(project)
        return True


class RuleListCache:
    """Parsed rule lists by key; contents that don't parse change nothing, and one call tells of all changes of a round."""

    def __init__(self, on_change: Callable[[dict[str, RuleList]], None]):
        self.on_change, self.lists, self.hashes, self.enabled = on_change, {}, {}, {}

    def refresh(self, contents: dict[str, str], priorities: dict[str, int] | None = None) -> dict[str, str]:
        """Takes contents by key; errors by key."""
        errors, changed = {}, False
        for key, text in contents.items():
            digest = hashlib.sha256(text.encode()).hexdigest()
            if self.hashes.get(key) == digest:
                continue
            try:
                made = parse_rules(text, key, (priorities or {}).get(key, 0))
            except RuleError as e:
                errors[key] = str(e)
                continue
            self.lists[key], self.hashes[key], changed = made, digest, True
            self.enabled.setdefault(key, True)
        if changed:
            self.on_change(self.active())
        return errors

    def toggle(self, key: str, on: bool) -> None:
        if self.enabled[key] != on:
            self.enabled[key] = on
            self.on_change(self.active())

    def delete(self, key: str) -> None:
        """Forgets a list that is kept here; others can't be deleted."""
        if key not in self.lists:
            raise KeyError(key)
        for known in (self.lists, self.hashes, self.enabled):
            del known[key]
        self.on_change(self.active())

    def active(self) -> dict[str, RuleList]:
        return {k: v for k, v in self.lists.items() if self.enabled[k]}
