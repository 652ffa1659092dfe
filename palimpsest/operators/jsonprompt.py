"""Redaction of prompt-like fields inside JSON bodies of any depth.

Under the keys messages, input and contents strings, items' content, parts and text, and parts' text
are prompts; anything else stays. One Arrow function takes the prompts out, Columns find hits in
them, another puts placeholders in. A body without a change is returned byte for byte; a changed one has sorted keys and
HTML characters escaped, and its numbers as they were written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .engine import PiiEngine
from .python_columns import with_python

#: Between prompts: it ends any escape sequence, and no segment holds it.
BETWEEN = "\x1b\\\x07"
CONTAINERS = ("messages", "input", "contents")
REMINDER = re.compile(r"\s*<system-reminder.*</system-reminder>", re.DOTALL)


class Number(str):
    """A number as it was written."""


def refuse(name: str):
    raise ValueError(name)


def parse(body: str):
    return json.loads(body, parse_int=Number, parse_float=Number, parse_constant=refuse)


def walk(value, change: Callable[[str], str]):
    """value with change() applied to its prompts, in the order of the document."""
    if isinstance(value, dict):
        return {k: container(v, change) if k in CONTAINERS else walk(v, change) for k, v in value.items()}
    return [walk(v, change) for v in value] if isinstance(value, list) else value


def is_text(value) -> bool:
    return isinstance(value, str) and not isinstance(value, Number)


def container(value, change):
    if is_text(value):
        return change(value)
    return [item(v, change) for v in value] if isinstance(value, list) else walk(value, change)


def item(value, change):
    if is_text(value):
        return change(value)
    if not isinstance(value, dict):
        return value
    made = dict(value)
    for key in ("content", "parts", "text"):
        if key in made:
            made[key] = content(made[key], change) if key != "text" else change(made[key]) if is_text(made[key]) else made[key]
    return made


def content(value, change):
    if isinstance(value, list):
        return [part(v, change) for v in value]
    return part(value, change)


def part(value, change):
    if is_text(value):
        return change(value)
    if isinstance(value, dict) and is_text(value.get("text")) and not REMINDER.match(value["text"]):
        return value | {"text": change(value["text"])}
    return value


def dump(value) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{dump(k)}:{dump(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    text = json.dumps(value, ensure_ascii=False)
    return re.sub("[<>&  ]", lambda m: f"\\u{ord(m[0]):04x}", text) if isinstance(value, str) else text


def prompts(body: str | None) -> list[str] | None:
    """The prompts of a body; None if it isn't one JSON value."""
    found: list[str] = []
    try:
        walk(parse(body), lambda s: found.append(s) or s)
    except (ValueError, TypeError, RecursionError):
        return None
    return found


def rebuilt(body: str, change: Callable[[str], str]) -> str:
    changed = []

    def new(old: str) -> str:
        made = change(old)
        changed.append(made != old)
        return made

    made = walk(parse(body), new)
    return dump(made) if any(changed) else body


def put_back(body: str, hits: list[dict]) -> tuple[str, int]:
    """body with the hits of its joined prompts replaced, and how many they are."""
    at, used = 0, 0

    def change(prompt: str) -> str:
        nonlocal at, used
        raw, out, last = prompt.encode(), b"", 0
        for h in hits:
            if at <= h["start"] and h["end"] <= at + len(raw):
                out += raw[last:h["start"] - at] + h["placeholder"].encode()
                last, used = h["end"] - at, used + 1
        at += len(raw) + len(BETWEEN)
        return (out + raw[last:]).decode()

    return rebuilt(body, change), used


def is_valid(body: str | None) -> bool:
    try:
        parse(body)
    except (ValueError, TypeError, RecursionError):
        return False
    return True


def with_validity(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with whether texts are one JSON value: column to the new one's name. All in one operator, as each has Python workers of its own."""
    return with_python(df, list(names), [T.StructField(n, T.BooleanType()) for n in names.values()], lambda *bodies: tuple(map(is_valid, bodies)))


def redact_json(engine: PiiEngine, docs: DataFrame, body_col: str, as_json: Column | None = None) -> DataFrame:
    """docs with is_json, redacted_body, n_hits and hits; a body that isn't JSON, or of a row without as_json, is redacted as a whole, a null one stays null.

    Row by row: prompts are joined to one text by protected characters, so no hit spans two of them.
    """
    kept = [c for c in docs.columns if c not in ("is_json", "redacted_body", "n_hits", "hits")]
    rows = docs.select(*[docs[c] for c in kept], docs[body_col].alias("body_in_hand_"), (F.lit(True) if as_json is None else F.coalesce(as_json, F.lit(False))).alias("as_json_"))
    rows = with_python(rows, ["body_in_hand_", "as_json_"], [T.StructField("prompts_", T.ArrayType(T.StringType()))], lambda body, read: (prompts(body) if read else None,))
    rows = rows.withColumn("is_json", F.col("prompts_").isNotNull())
    rows = rows.withColumn("text_in_hand_", F.when(F.col("is_json"), F.array_join("prompts_", BETWEEN)).otherwise(F.col("body_in_hand_")))
    rows = engine.redact(rows, "text_in_hand_")
    hits = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["placeholder"].alias("placeholder")))
    rows = rows.withColumn("places_", F.when(F.col("is_json"), hits))
    rows = with_python(rows, ["body_in_hand_", "places_"], [T.StructField("made_", T.StringType()), T.StructField("n_", T.LongType())], lambda body, places: put_back(body, places) if places is not None else (None, None))
    return rows.select(*kept, "is_json", F.when(F.col("is_json"), F.col("made_")).otherwise(F.col("redacted")).alias("redacted_body"),
                       F.when(F.col("is_json"), F.col("n_")).otherwise(F.greatest(F.size("hits"), F.lit(0)).cast("long")).alias("n_hits"), "hits")
