"""The line-based rule language: parsing, checking and translating rules for Spark.

A rule is a line "kind category pattern": kind is keyword (k) or regex (r) in any case, the category
ends at the first blank or tab. Blank lines and lines that begin with #, ;, ! or // are skipped. One
bad line rejects the list. Patterns are RE2; java_pattern() gives the Java pattern that matches alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_PRIORITY, TOP_PRIORITY, KEYWORD_PRIORITY, NER_PRIORITY = 50, 99, 100, 40
LONGEST_LINE = 1 << 20
DEFAULT_RULES = Path(__file__).with_name("default.rules")

# The built-in patterns by name, with their categories.
BUILTIN = {
    "email": ("EMAIL", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    "china_phone": ("CHINA_PHONE", r"(?:^|\D)(1[3-9]\d{9})(?:$|\D)"),
    "china_id": ("CHINA_ID", r"(?:^|\D)(\d{17}[\dXx])(?:$|\D)"),
    "uuid": ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"),
    "ipv4": ("IPV4", r"(?:\d{1,3}\.){3}\d{1,3}"),
    "mac": ("MAC", r"(?i)(?:[0-9a-f]{2}:){5}[0-9a-f]{2}"),
}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    kind: str
    category: str
    pattern: str


@dataclass
class RuleList:
    rules: list[Rule]
    name: str = "rules"
    priority: int = DEFAULT_PRIORITY

    def __post_init__(self):
        self.priority = DEFAULT_PRIORITY if self.priority <= 0 else min(self.priority, TOP_PRIORITY)

    @property
    def keyword_count(self) -> int:
        return sum(r.kind == "keyword" for r in self.rules)

    @property
    def regex_count(self) -> int:
        return sum(r.kind == "regex" for r in self.rules)


def clean_pattern(value: str) -> str:
    """Without control and format characters, trimmed."""
    import unicodedata

    return "".join(c for c in value.strip() if unicodedata.category(c) not in ("Cc", "Cf")).strip()


def clean_category(value: str) -> str:
    """[A-Z0-9_]: blanks, hyphens and underscores become one underscore, anything else goes."""
    value = re.sub(r"[^A-Za-z0-9_\-\s]", "", clean_pattern(value))
    return re.sub(r"[_\-\s]+", "_", value).strip("_").upper()


def cut_field(text: str) -> tuple[str, str]:
    m = re.match(r"[^ \t]+", text)
    return (m[0], text[m.end():].strip()) if m else ("", "")


def parse_rules(text: str, name: str = "rules", priority: int = DEFAULT_PRIORITY) -> RuleList:
    rules = []
    for number, line in enumerate(text.split("\n"), 1):
        if len(line.encode()) > LONGEST_LINE:
            raise RuleError(f"line {number}: longer than {LONGEST_LINE} bytes")
        line = line.strip()
        if not line or line.startswith(("#", ";", "!", "//")):
            continue
        kind, rest = cut_field(line)
        category, pattern = cut_field(rest)
        kind = {"k": "keyword", "r": "regex"}.get(kind.lower(), kind.lower())
        if kind not in ("keyword", "regex"):
            raise RuleError(f"line {number}: unknown kind {kind!r}")
        if not clean_category(category) or not pattern:
            raise RuleError(f"line {number}: category or pattern missing")
        if kind == "regex":
            try:
                java_pattern(pattern)
            except (RuleError, re.error) as e:
                raise RuleError(f"line {number}: {e}") from e
        else:
            pattern = clean_pattern(pattern)
        rules.append(Rule(kind, clean_category(category), pattern))
    return RuleList(rules, name, priority)


def parse_rule_file(path: str | Path, priority: int = DEFAULT_PRIORITY) -> RuleList:
    return parse_rules(Path(path).read_text(), Path(path).stem, priority)


def default_rules() -> RuleList:
    return parse_rule_file(DEFAULT_RULES)


def builtin_rules(*names: str) -> RuleList:
    return RuleList([Rule("regex", *BUILTIN[n]) for n in names or BUILTIN], "builtin")


#: POSIX classes that RE2 has inside brackets.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "ascii": r"\p{ASCII}"}


#: Where a word of ASCII letters, digits and underscores begins or ends, and where not; Java's own knows other letters.
WORD = "[0-9A-Za-z_]"
BOUNDARY, NO_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))", f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"


def unquoted(pattern: str) -> str:
    """pattern with each character between \\Q and \\E escaped."""
    return re.sub(r"\\(?:Q(.*?)(?:\\E|\Z)|.)", lambda m: m[0] if m[1] is None else re.sub(r"[^\w\s]", r"\\\g<0>", m[1], flags=re.ASCII), pattern, flags=re.DOTALL)


def java_pattern(pattern: str) -> str:
    """The Java pattern that matches as RE2 does; what RE2 hasn't (lookaround, back references) is refused."""
    pattern = unquoted(pattern)
    out, i, n, in_class = [], 0, len(pattern), False
    flags, stack = frozenset(), []  # of m and U, here and outside each open group
    while i < n:
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1:i + 2]
            if not e:
                raise RuleError("trailing backslash")
            if e.isdigit() and e != "0" or e in "kCGRXhHVeZ":
                raise RuleError(f"\\{e} isn't in RE2")
            own = {"z": r"\z", "v": r"\x0B"} if in_class else {"z": r"\z", "v": r"\x0B", "b": BOUNDARY, "B": NO_BOUNDARY}
            out.append(own.get(e, "\\" + e))
            i += 2
            continue
        if in_class:
            if c == "[":
                m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
                if m and m[2] in POSIX:
                    out.append(POSIX[m[2]] if not m[1] else POSIX[m[2]].replace("\\p", "\\P").replace("\\s", "\\S").replace("\\w", "\\W"))
                    i += m.end()
                    continue
                out.append(r"\[")
            elif c == "&" and pattern[i + 1:i + 2] == "&":
                out.append(r"\&")
            else:
                in_class = c != "]"
                out.append(c)
        elif c == "[":
            in_class = True
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m[0].replace("]", r"\]"))
            i += m.end()
            continue
        elif c == "$":
            out.append(r"(?=\n|\z)" if "m" in flags else r"\z")
        elif c == "^" and "m" in flags:
            out.append(r"(?:(?<=\n)|\A)")
        elif pattern.startswith("(?", i):
            m = re.match(r"\(\?(?:P<(\w+)>|<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)]))", pattern[i:])
            if not m:
                raise RuleError(f"{pattern[i:i + 4]!r} isn't in RE2")
            if m[1] or m[2]:
                stack.append(flags)
                out.append(f"(?<{m[1] or m[2]}>")
            else:
                on, _, off = m[3].partition("-")
                if m[4] == ":":
                    stack.append(flags)
                flags = (flags | {x for x in on if x in "mU"}) - set(off)
                kept = re.sub("[mU]", "", on).replace("i", "iu", 1) + ("-" + re.sub("[mU]", "", off) if re.sub("[mU]", "", off) else "")
                out.append("(?" + kept + m[4] if kept or m[4] == ":" else "")
            i += m.end()
            continue
        elif c in "*+?" or c == "{" and (counted := re.match(r"\{\d+(?:,\d*)?\}", pattern[i:])):
            most = c if c != "{" else counted[0]
            i += len(most)
            if pattern[i:i + 1] == "+":
                raise RuleError("possessive repetition isn't in RE2")
            lazy = pattern[i:i + 1] == "?"
            i += lazy
            out.append(most + ("?" if lazy != ("U" in flags) else ""))
            continue
        else:
            if c == "(":
                stack.append(flags)
            elif c == ")" and stack:
                flags = stack.pop()
            out.append(c)
        i += 1
    if in_class:
        raise RuleError("bracket isn't closed")
    translated = "(?d)" + "".join(out)
    groups(pattern)
    return translated


def groups(pattern: str) -> list[tuple[int, int, int]]:
    """(start, end, depth) of each capture group; refuses unbalanced ones."""
    found, stack, i, in_class, pattern = [], [], 0, False, unquoted(pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += len(re.match(r"\[\^?\]?", pattern[i:])[0])
            continue
        elif c == "(":
            captures = not pattern.startswith("(?", i) or bool(re.match(r"\(\?(P?<\w+>)", pattern[i:]))
            if re.match(r"\(\?[imsU-]+\)", pattern[i:]):
                i = pattern.index(")", i) + 1
                continue
            stack.append((i, captures, len(found)))
            if captures:
                found.append((i, -1, len(stack) - 1))
        elif c == ")":
            if not stack:
                raise RuleError("bracket isn't opened")
            start, captures, k = stack.pop()
            if captures:
                found[k] = (start, i + 1, found[k][2])
        i += 1
    if stack:
        raise RuleError("bracket isn't closed")
    return found


def split_at_group(pattern: str) -> tuple[str, str, str] | None:
    """Before, inside and after the only capture group, or nothing, the pattern and nothing; None if it is nested, optional or one of several, or if flags are set later on."""
    pattern = unquoted(pattern)
    own = groups(pattern)
    flags = re.match(r"(?:\(\?[imsU-]+\))*", pattern)[0]
    if not own:
        return flags, pattern[len(flags):], ""
    start, end, depth = own[0]
    if len(own) > 1 or depth or pattern[end:end + 1] in ("?", "*", "+", "{") or has_top_alternation(pattern[len(flags):]) or sets_flags(pattern[len(flags):]):
        return None
    return pattern[:start], pattern[start + 1:end - 1], pattern[end:]


def sets_flags(pattern: str) -> bool:
    """Whether flags are set for what follows in a group; such a pattern can't be cut."""
    return bool(re.search(r"\(\?[imsU-]+\)", re.sub(r"\\.", "__", pattern, flags=re.DOTALL)))


def has_top_alternation(pattern: str) -> bool:
    depth, i, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += len(re.match(r"\[\^?\]?", pattern[i:])[0])
            continue
        depth += (c == "(" and not in_class) - (c == ")" and not in_class)
        if c == "|" and not depth and not in_class:
            return True
        i += 1
    return False


@dataclass
class Config:
    """Driver-side settings; merge() lays a project's over the global ones."""

    keywords: list[tuple[str, str]] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    rule_lists: list[RuleList] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    ner_enabled: bool = False
    ner_entities: list[str] = field(default_factory=list)
    ner_min_score: float = 0.0
    intercept_mode: str = ""
    wal: bool = True
    deterministic: bool = False
    prefix: str = "__VG_"  # fixed value
    ttl_seconds: int = 3600
    max_mappings: int = 100_000

    def __post_init__(self):
        self.ner_min_score = min(1.0, max(0.0, self.ner_min_score))
        seen: dict[str, RuleList] = {}
        for r in self.rule_lists:
            seen.setdefault(r.name, r)
        self.rule_lists = list(seen.values())
        self.intercept_mode = self.intercept_mode if self.intercept_mode in ("global", "targets") else "global"

    def add_keyword(self, text: str, category: str = "") -> None:
        text = clean_pattern(text)
        if not text:
            raise RuleError("empty keyword")
        self.keywords.append((text, clean_category(category) or "TEXT"))

    def update_keyword(self, index: int, text: str, category: str = "") -> None:
        self.keywords[index] = (clean_pattern(text), clean_category(category) or "TEXT")

    def delete_keyword(self, index: int) -> None:
        del self.keywords[index]

    def add_rule_list(self, text: str, name: str, priority: int = DEFAULT_PRIORITY) -> RuleList:
        """Parsed before it is kept: a bad list changes nothing."""
        made = parse_rules(text, name, priority)
        self.rule_lists = [r for r in self.rule_lists if r.name != name] + [made]
        return made

    def delete_rule_list(self, name: str) -> None:
        self.rule_lists = [r for r in self.rule_lists if r.name != name]

    def merge(self, project: Config) -> Config:
        """Lists append, entities replace, other values override if set, switches only turn on; wal and deterministic stay."""
        return Config(
            self.keywords + project.keywords, self.excludes + project.excludes, self.rule_lists + project.rule_lists, self.targets + project.targets,
            self.ner_enabled or project.ner_enabled, project.ner_entities or self.ner_entities, project.ner_min_score or self.ner_min_score, project.intercept_mode if project.intercept_mode != "global" else self.intercept_mode,
            self.wal, self.deterministic, project.prefix or self.prefix, project.ttl_seconds or self.ttl_seconds, project.max_mappings or self.max_mappings,
        )


def merge_keywords(configured: list[tuple[str, str]], secrets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(text, category), configured ones first, one for each text."""
    out: dict[str, str] = {}
    for text, category in [*configured, *secrets]:
        out.setdefault(text, category)
    return list(out.items())


def rules_frame(spark: SparkSession, lists: list[RuleList]) -> DataFrame:
    rows = [(i, r.kind, r.category, r.pattern, lst.priority, lst.name) for i, (lst, r) in enumerate((lst, r) for lst in lists for r in lst.rules)]
    return spark.createDataFrame(rows, "rule_ord int, kind string, category string, pattern string, priority int, list_name string")


def secret_keywords(lines: DataFrame, style: str, min_value_len: int = 8, category: str | None = None) -> DataFrame:
    """Keyword rows (pattern, category) from a text column `value`: dotenv (KEY=VALUE; export, quotes and " #" comments are taken away) or lines."""
    least = min(1024, min_value_len if min_value_len > 0 else 8)
    line = F.trim("value")
    rows = lines.filter((line != "") & ~line.rlike(r"^(#|;|!|//)"))
    if style == "dotenv":
        value = F.trim(F.regexp_extract(line, r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_.]*\s*=\s*(.*)$", 1))
        quoted = F.regexp_extract(value, r"""^(?:"([^"]*)"|'([^']*)')""", 0)
        value = F.when(quoted != "", F.expr("substring(quoted, 2, length(quoted) - 2)")).otherwise(F.regexp_replace(value, r"\s+#.*$", ""))
        rows = rows.withColumn("quoted", quoted)
    else:
        value = line
    return rows.select(value.alias("pattern")).filter(F.length("pattern") >= least).distinct().withColumn("category", F.lit(category or ("DOTENV" if style == "dotenv" else "SECRET_FILE")))
