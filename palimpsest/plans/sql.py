"""Pieces of DuckDB SQL that say what the engine computes, for checking results."""

from __future__ import annotations

from ..operators.dictionary import PREFIX
from ..sources.rules import RuleList, split_at_group


def text(value: str) -> str:
    """A string literal; control characters by chr()."""
    parts = ["'" + "".join(c for c in run).replace("'", "''") + "'" for run in [value]]
    if all(ord(c) >= 32 for c in value):
        return parts[0]
    out, run = [], ""
    for c in value:
        if ord(c) < 32:
            out += ["'" + run.replace("'", "''") + "'", f"chr({ord(c)})"]
            run = ""
        else:
            run += c
    return "(" + " || ".join([*out, "'" + run.replace("'", "''") + "'"]) + ")"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, bytes):
        return f"unhex('{value.hex()}')"
    return text(value) if isinstance(value, str) else repr(value)


def values(rows: list[tuple], columns: str) -> str:
    """SELECT over literal rows; columns is a Spark schema string, whose types are kept."""
    kinds = {"int": "INTEGER", "long": "BIGINT", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP", "binary": "BLOB"}
    names = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"{n}::{kinds[k]} AS {n}" for n, k in names) + f" FROM (VALUES {body}) AS v({', '.join(n for n, _ in names)})"


def dealt(rows: list[tuple], columns: str, id_name: str = "row_id", cases: int | None = None) -> str:
    """Rows of cases (case_, from 0) dealt to all events in turn: the event's id and the rows' other columns."""
    return f"SELECT event_id AS {id_name}, v.* EXCLUDE (case_) FROM events JOIN ({values(rows, columns)}) v ON event_id % {cases or len(rows)} = v.case_"


def numbered(rows: list[tuple]) -> list[tuple]:
    """Rows as cases of their own."""
    return [(k, *r) for k, r in enumerate(rows)]


def expected(rows: list[tuple], columns: str, cases: int, first: int = 0) -> str:
    """What each event's case leads to: row_id (the event's) and the rows of the case, which `id` numbers from `first`."""
    return f"SELECT event_id AS row_id, v.* FROM events JOIN ({values(rows, columns)}) v ON event_id % {cases} + {first} = v.id"


def candidates(source: str, lists: list[RuleList], keywords: list[tuple[str, str]] = (), columns: str = "id") -> str:
    """id, start_, end_ (bytes), c0, c1 (characters), category, priority, rule_ord, original of all hits in source (id, text) without protected characters."""
    todo = [("keyword", t, c, 100) for t, c in keywords] + [(r.kind, r.pattern, r.category, lst.priority) for lst in lists for r in lst.rules]
    selects = []
    for ord_, (kind, pattern, category, priority) in enumerate(todo):
        if kind == "keyword":
            parts = f"string_split(text, {text(pattern)})"
            pieces = f"list_reduce(list_transform({parts}, lambda p: [p]), lambda a, p: a || [{text(pattern)}] || p)"
            where = f"contains(text, {text(pattern)})"
        else:
            before, group, after = split_at_group(pattern)
            flags = "(?i)" if before.startswith("(?i)") or pattern.startswith("(?i)") else ""
            before = before.removeprefix("(?i)")
            pieces = f"regexp_split_to_array(regexp_replace(text, {text(f'{flags}({before})({group})({after})')}, '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g'), '[' || chr(2) || chr(3) || ']')"
            where = f"regexp_matches(text, {text(pattern)})"
        selects.append(f"SELECT {columns}, {ord_} AS rule_ord, {text(category)} AS category, {priority} AS priority, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM (SELECT {columns}, {pieces} AS parts FROM {source} WHERE {where})")
    return f"""SELECT {columns}, start_, (start_ + strlen(original))::INTEGER AS end_, c0, c0 + length(original) AS c1, category, priority, rule_ord, original FROM (
  SELECT {columns}, coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: strlen(p))), 0)::INTEGER AS start_, coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0)::INTEGER AS c0,
    category, priority::INTEGER AS priority, rule_ord, parts[i] AS original FROM ({' UNION ALL '.join(selects)})) WHERE original <> ''"""


def greedy(source: str) -> str:
    """The rows of source (as candidates() makes them) that greedy resolution takes."""
    return f"""SELECT id, unnest(taken, recursive := true) FROM (
  SELECT id, list_reduce(list_transform(ranked, lambda c: [c]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].start_ < y.end_ AND y.start_ < x[1].end_)) = 0 THEN acc || x ELSE acc END) AS taken FROM (
    SELECT id, list({{'start_': start_, 'end_': end_, 'c0': c0, 'c1': c1, 'category': category, 'priority': priority, 'rule_ord': rule_ord, 'original': original}} ORDER BY priority DESC, end_ - start_ DESC, start_, rule_ord, category) AS ranked FROM ({source}) GROUP BY id))"""


def hmac(key: bytes, value: str) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def placeholder(key: bytes, category: str = "category", original: str = "original", prefix: str = PREFIX) -> str:
    return f"'{prefix}' || {category} || '_' || substr({hmac(key, original)}, 1, 12) || '__'"


def replaced(docs: str, hits: str, replacement: str) -> str:
    """id, redacted: docs (id, text) with hits (id, c0, c1) replaced."""
    return f"""SELECT d.id, coalesce(r.out || substr(d.text, r.last_ + 1), d.text) AS redacted FROM ({docs}) d LEFT JOIN (
  SELECT id, string_agg(substr(text, before_ + 1, c0 - before_) || new, '' ORDER BY c0) AS out, max(c1) AS last_ FROM (
    SELECT h.id, d2.text, h.c0, h.c1, {replacement} AS new, coalesce(lag(h.c1) OVER (PARTITION BY h.id ORDER BY h.c0), 0) AS before_ FROM ({hits}) h JOIN ({docs}) d2 USING (id)) GROUP BY id) r USING (id)"""
