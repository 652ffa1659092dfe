"""Span kernels: safe segments, detection, exclusion, overlap resolution and replacement.

All are Columns on one row: no shuffle, no Python. Offsets count UTF-8 bytes, half open.
"""

from __future__ import annotations

import re
import re._parser as sre_parser

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, functions as F

from .arrow_hits import keyword_hits_udf, regex_hits_udf
from ..sources.rules import KEYWORD_PRIORITY, Rule, RuleList, groups, java_pattern, split_at_group, unquoted

#: Escape sequences, and control and format characters other than line feed, carriage return and tab.
PROTECTED = r"\x1b\[[^@-~]*(?:[@-~]|\z)|\x1b[\]PX^_](?s:.*?)(?:\x07|\x1b\\|\z)|\x1b(?s:.)?|[\p{Cc}\p{Cf}&&[^\n\r\t]]"
CANDIDATE = "struct<start:int,end:int,category:string,priority:int,source:string,rule_ord:int,original:string>"
NONE = f"array<{CANDIDATE}>"
#: Whether a segment is asked for what every match of a rule holds before the rule's own pattern runs.
PREFILTERS = True
#: More keywords are looked for by one automaton, fewer by an expression each.
MANY_KEYWORDS = 64


def no_candidates() -> Column:
    return F.array().cast(NONE)


#: Folds append to arrays of so many elements at most, which are joined once: an array that grows by one is copied each time.
FOLDED = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of values (array<int>) what step() has made of 0 and all values before it."""
    part = "struct<at:int,out:array<int>>"

    def chunk(acc: Column, some: Column) -> Column:
        zero = F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0)).alias("at"), F.array().cast("array<int>").alias("out")).cast(part)
        made = F.aggregate(some, zero, lambda a, v: F.struct(step(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")).cast(part))
        return F.concat(acc, F.array(made)).cast(f"array<{part}>")

    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLDED).cast("int")), lambda k: F.slice(v, k * FOLDED + 1, F.lit(FOLDED)))
    folded = lambda v: F.flatten(F.transform(F.aggregate(chunks(v), F.array().cast(f"array<{part}>"), chunk), lambda c: c["out"]))
    return let(values, lambda v: F.when(F.size(v) > 0, folded(v)).otherwise(F.array().cast("array<int>")))


def running_sum_sql(values: str) -> str:
    """SQL for the sums of all values before each of an array<int> with a value at least."""
    part, empty = "struct<at:int,out:array<int>>", "CAST(array() AS array<int>)"
    one = f"aggregate(slice(z, CAST(k * {FOLDED} + 1 AS INT), {FOLDED}), CAST(named_struct('at', coalesce(try_element_at(acc, -1).at, 0), 'out', {empty}) AS {part}), (a, v) -> CAST(named_struct('at', a.at + v, 'out', concat(a.out, array(a.at))) AS {part}))"
    return f"transform(array({values}), z -> flatten(transform(aggregate(sequence(0, CAST((size(z) - 1) DIV {FOLDED} AS INT)), CAST(array() AS array<{part}>), (acc, k) -> CAST(concat(acc, array({one})) AS array<{part}>)), c -> c.out)))[0]"


def pieces_with_offsets(pieces: Column, gaps: Column) -> Column:
    """array<struct<off, seg>> of pieces that stand between gaps of so many bytes."""
    sizes = lambda p: F.zip_with(p, gaps, lambda x, g: (F.octet_length(x) + F.coalesce(g, F.lit(0))).cast("int"))
    return let(pieces, lambda p: F.zip_with(running(sizes(p), lambda a, v: a + v), p, lambda at, x: F.struct(at.alias("off"), x.alias("seg"))))


def safe_segments(text: Column) -> Column:
    """The parts of text between protected sequences, with their byte offsets; empty ones are left out."""
    whole = F.array(F.struct(F.lit(0).alias("off"), text.alias("seg")))
    gaps = F.transform(F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0)), F.octet_length)
    cut = F.filter(pieces_with_offsets(F.split(text, PROTECTED, -1), gaps), lambda s: s["seg"] != "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<struct<off:int,seg:string>>")).when(text.rlike(PROTECTED), cut).otherwise(whole)


DIGITS = frozenset("0123456789")


def one_case(c: str) -> bool:
    return c.lower() == c == c.upper()


def parsed(pattern: str):
    """The pattern as Python reads it; None if it would read it otherwise."""
    pattern = unquoted(pattern)
    if re.search(r"\[:\^?\w+:\]", pattern):
        return None
    try:
        return sre_parser.parse(pattern)
    except (re.error, OverflowError):
        return None


def needed(items) -> list[frozenset[str]]:
    """Sets of digits and of characters without case, of each of which every match holds one."""
    out = []
    for op, arg in items:
        if op is sre_parser.LITERAL:
            out.append(some_of([(op, arg)]))
        elif op is sre_parser.IN:
            out.append(some_of(arg))
        elif op is sre_parser.SUBPATTERN:
            out += needed(arg[3])
        elif op in (sre_parser.MAX_REPEAT, sre_parser.MIN_REPEAT) and arg[0] >= 1:
            out += needed(arg[2])
        elif op is sre_parser.BRANCH:
            least = [min(needed(b), key=len, default=frozenset()) for b in arg[1]]
            out.append(frozenset().union(*least) if all(least) else frozenset())
    return [s for s in out if s]


def some_of(items) -> frozenset[str]:
    """The characters of a class of digits and characters without case; none for other classes."""
    out = set()
    for op, arg in items:
        if op is sre_parser.CATEGORY and arg is sre_parser.CATEGORY_DIGIT:
            out |= DIGITS
        elif op is sre_parser.RANGE and chr(arg[0]) in DIGITS and chr(arg[1]) in DIGITS:
            out |= set(map(chr, range(arg[0], arg[1] + 1)))
        elif op is sre_parser.LITERAL and (chr(arg) in DIGITS or not chr(arg).isalnum() and one_case(chr(arg))):
            out.add(chr(arg))
        else:
            return frozenset()
    return frozenset(out)


def needs_digit(pattern: str) -> bool:
    """Whether every match of a pattern holds an ASCII digit."""
    tree = parsed(pattern)
    return tree is not None and any(s <= DIGITS for s in needed(tree))


def begins_with(pattern: str) -> list[str]:
    """The words of which every match of (?i)(?:word|word)... holds one, in lower case; none for other patterns. A long s isn't lowered, so words hold no s."""
    cut = re.match(r"\(\?i\)\(\?:([a-rt-z]{3,}(?:\|[a-rt-z]{3,})*)\)(?![?*{])", pattern)
    return cut[1].split("|") if cut else []


def required(pattern: str) -> tuple[str | None, str | None]:
    """What every match of a pattern holds: the longest literal, and the smallest set of a few characters (as a bracket); each None if there is none.

    Both are looked for before the regular expression runs. Characters whose case doesn't count, by the
    pattern's flags or a group's own, are no literals. Patterns that Python would read otherwise have neither.
    """
    tree = parsed(pattern)
    if tree is None:
        return None, None
    runs = [""]
    sets = ["[" + "".join("\\" + c for c in sorted(s)) + "]" for s in needed(tree) if not s & DIGITS]

    def walk(items, fold: bool) -> None:
        for op, arg in items:
            if op is sre_parser.LITERAL and (not fold or one_case(chr(arg))):
                runs[-1] += chr(arg)
            elif op is sre_parser.SUBPATTERN:
                _, on, off, inner = arg
                walk(inner, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            else:
                runs.append("")
                if op is sre_parser.MAX_REPEAT and arg[0] >= 1:
                    walk(arg[2], fold)
                    runs.append("")

    walk(tree, bool(tree.state.flags & re.IGNORECASE))
    return max(runs, key=len) or None, min(sets, key=len, default=None)


def quoted(value: str) -> str:
    """A Spark SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\x02", "\\u0002").replace("\x03", "\\u0003") + "'"


def placed(parts: str, gap: int, keep: str, rule: Rule, priority: int, source: str, rule_ord: int, value: str) -> str:
    """SQL for candidates from a split segment: each part's place is the sum of the lengths before it."""
    start = "o[i] + s.off" if keep == "odd" else "o[i] + octet_length(x) + s.off"
    size = "octet_length(x)" if keep == "odd" else str(gap)
    made = f"named_struct('start', {start}, 'end', {start} + {size}, 'category', {quoted(rule.category or 'REGEX')}, 'priority', {priority}, 'source', {quoted(source)}, 'rule_ord', {rule_ord}, 'original', {value})"
    wanted = "i % 2 = 1 AND x <> ''" if keep == "odd" else "i < size(p) - 1"
    sums = running_sum_sql(f"transform(p, x -> CAST(octet_length(x) + {gap} AS INT))")
    return f"CAST(transform(array({parts}), p -> transform(array({sums}), o -> filter(transform(p, (x, i) -> IF({wanted}, {made}, NULL)), h -> h IS NOT NULL))[0])[0] AS {NONE})"


def regex_hits(rule: Rule, priority: int, source: str, rule_ord: int) -> str | None:
    """SQL for a rule's candidates in segment s (off, seg); None if its group can't be marked.

    Marks are put around the group in each match, and the marked segment is split at them: the parts
    between two marks are hits, and the lengths of parts give their offsets. Marks are control
    characters, which segments don't hold.
    """
    cut = split_at_group(rule.pattern)
    if cut is None:
        return None
    before, group, after = cut
    marked = f"split(regexp_replace(s.seg, {quoted(regroup(java_pattern(f'{before}({group}){after}')))}, {quoted('$1' + chr(2) + '$2' + chr(3) + '$3')}), {quoted('[' + chr(2) + chr(3) + ']')}, -1)"
    # cheapest first: what every match holds, then the group alone, which fails at most characters at once
    literal, some = required(rule.pattern)
    may = [f"contains(s.seg, {quoted(literal)})"] if literal else []
    few = [] if some is None else some[2:-1].split("\\")  # each of the set's characters follows a backslash
    if some and not set(few) & set(literal or ""):
        may.append("(" + " OR ".join(f"contains(s.seg, {quoted(c)})" for c in few) + ")" if len(few) <= 3 and all(few) else f"s.seg RLIKE {quoted(some)}")
    words = begins_with(rule.pattern)
    may += ["(" + " OR ".join(f"contains(lower(s.seg), {quoted(w)})" for w in words) + ")"] if words and not some else []
    may.append(f"s.seg RLIKE {quoted(java_pattern(before_flags(before) + group))}")
    may = may if PREFILTERS else ["true"]
    return f"IF({' AND '.join(may)}, {placed(marked, 0, 'odd', rule, priority, source, rule_ord, 'x')}, CAST(array() AS {NONE}))"


def before_flags(before: str) -> str:
    return re.match(r"(?:\(\?[imsU-]+\))*", before)[0]


def regroup(java: str) -> str:
    """(?d)before(group)after as (?d)(before)(group)(after), global flags in front."""
    flags = re.match(r"(?:\(\?[a-z-]+\))*", java)[0]
    start, end, _ = groups(java)[0]
    return f"{flags}({java[len(flags):start]}){java[start:end]}({java[end:]})"


def keyword_hits(rule: Rule, priority: int, source: str, rule_ord: int) -> str:
    """SQL for a keyword's leftmost occurrences in segment s that don't overlap; letters' case counts."""
    word = rule.pattern
    parts = f"split(s.seg, {quoted(chr(92) + 'Q' + word.replace(chr(92) + 'E', chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q') + chr(92) + 'E')}, -1)"
    return f"IF(contains(s.seg, {quoted(word)}), {placed(parts, len(word.encode()), 'all but the last', rule, priority, source, rule_ord, quoted(word))}, CAST(array() AS {NONE}))"


def detect(segments: str, lists: list[RuleList], keywords: list[tuple[str, str]] = ()) -> Column:
    """All candidates in a column of safe segments: keywords first, then rule lists in their order, each segment on its own.

    One SQL expression, parsed once; patterns with a nested or optional group and many keywords run as Arrow UDFs.
    """
    todo: list[tuple[Rule, int, str]] = [(Rule("keyword", c, t), KEYWORD_PRIORITY, "keywords") for t, c in keywords if t and c]
    todo += [(r, lst.priority, f"rulelist:{lst.name}") for lst in lists for r in lst.rules]
    native, other = [], []
    words = [(r.pattern, r.category, priority, source, ord_) for ord_, (r, priority, source) in enumerate(todo) if r.kind == "keyword"]
    if len(words) > MANY_KEYWORDS:
        other.append(beside(segments, keyword_hits_udf(words)))
    for ord_, (rule, priority, source) in enumerate(todo):
        if rule.kind == "keyword" and len(words) > MANY_KEYWORDS:
            continue
        made = (keyword_hits if rule.kind == "keyword" else regex_hits)(rule, priority, source, ord_)
        if made is None:
            other.append(beside(segments, regex_hits_udf(rule.pattern, rule.category or "REGEX", priority, source, ord_)))
        else:
            native.append((rule.kind == "regex" and PREFILTERS and needs_digit(rule.pattern), made))
    # rules that stand side by side and need a digit ask for one together
    runs = [(digit, [m for _, m in run]) for digit, run in groupby(native, key=lambda x: x[0])]
    asked = [f"IF(s.seg RLIKE '[0-9]', concat({', '.join(run)}), CAST(array() AS {NONE}))" if digit else ", ".join(run) for digit, run in runs]
    found = [F.expr(f"flatten(transform({segments}, s -> concat({', '.join(asked)})))")] if native else []
    return F.coalesce(F.concat(*found, *other), no_candidates()) if found or other else no_candidates()


def beside(segments: str, find: Callable[[Column], Column]) -> Column:
    """find() as an Arrow UDF of a column of segments. The column is asked for twice, so that the optimizer keeps it as one: it loses track of a UDF whose arguments hold lambda functions."""
    return F.when(F.size(segments) > 0, find(F.col(segments))).otherwise(no_candidates())


def exclude(candidates: Column, values: list[str]) -> Column:
    """Without hits on excluded values, and without empty categories."""
    kept = F.filter(candidates, lambda c: c["category"] != "")
    return F.filter(kept, lambda c: ~c["original"].isin(*values)) if values else kept


def by_cluster(ordered: Column, resolve: Callable[[Column], Column]) -> Column:
    """resolve() of each run of spans, ordered by start, that hang together by overlaps; spans without any stay as they are.

    Overlaps don't reach from one cluster to another, so what resolve() costs is bounded by the largest
    cluster, and the rest is linear.
    """

    def cut(c: Column) -> Column:
        ends = running(F.transform(c, lambda x: x["end"].cast("int")), lambda a, v: F.greatest(a, v))
        first = lambda e: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i)["start"] >= F.get(e, i)))
        slices = lambda f: F.transform(f, lambda b, k: F.slice(c, b + 1, F.coalesce(F.get(f, k + 1), F.size(c)) - b))
        clusters = let(let(ends, first), slices)
        return F.flatten(F.transform(clusters, lambda x: F.when(F.size(x) > 1, resolve(x)).otherwise(x)))

    apart = lambda c: F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1)["end"] <= F.get(c, i)["start"])
    return let(ordered, lambda c: F.when(F.size(c) <= 1, c).when(apart(c), c).otherwise(cut(c)))


def greedy(candidates: Column) -> Column:
    """By priority, length, start (then rule order, category): each that overlaps none taken before. In the order of start."""

    def one(cluster: Column) -> Column:
        order = F.transform(cluster, lambda c: F.struct((-c["priority"]).alias("p"), (c["start"] - c["end"]).alias("n"), c["start"].alias("s"), c["rule_ord"].alias("r"), c["category"].alias("g"), c.alias("c")))
        ranked = F.transform(F.array_sort(order), lambda x: x["c"])
        free = lambda acc, x: ~F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
        taken = F.aggregate(ranked, no_candidates(), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
        return F.array_sort(taken)

    return F.when(F.size(candidates) > 1, by_cluster(F.array_sort(candidates), one)).otherwise(candidates)


def split_resolution(candidates: Column, text: Column) -> Column:
    """By start then end, last first: of each the parts that nothing before it covers. In the order of start."""
    raw = text.cast("binary")
    span = "array<struct<s:int,e:int>>"

    def minus(parts: Column, y: Column) -> Column:
        left = F.filter(F.transform(parts, lambda p: F.struct(p["s"].alias("s"), F.least(p["e"], y["s"]).alias("e"))), lambda p: p["s"] < p["e"])
        right = F.filter(F.transform(parts, lambda p: F.struct(F.greatest(p["s"], y["e"]).alias("s"), p["e"].alias("e"))), lambda p: p["s"] < p["e"])
        return F.concat(left, right)

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(x["c"]["start"].alias("s"), x["c"]["end"].alias("e")))
        parts = F.aggregate(acc["covered"], own.cast(span), minus)
        made = F.transform(parts, lambda p: x["c"].withField("start", p["s"]).withField("end", p["e"]))
        return F.struct(F.concat(acc["covered"], own).cast(span).alias("covered"), F.concat(acc["out"], made).cast(NONE).alias("out"))

    def one(cluster: Column) -> Column:
        order = F.array_sort(F.transform(cluster, lambda c: F.struct((-c["start"]).alias("s"), (-c["end"]).alias("e"), c["rule_ord"].alias("r"), c.alias("c"))))
        zero = F.struct(F.array().cast(span).alias("covered"), no_candidates().alias("out"))
        return F.array_sort(F.aggregate(order, zero, step, lambda acc: acc["out"]))

    left = F.when(F.size(candidates) > 1, by_cluster(F.array_sort(candidates), one)).otherwise(candidates)
    return F.transform(left, lambda c: c.withField("original", F.substring(raw, c["start"] + 1, c["end"] - c["start"]).cast("string")))


def last_first(hits: Column) -> Column:
    """Hits in the order of start, last first, as matches are reported."""
    return F.reverse(hits)


def replace_spans(text: Column, spans: Column, replacement: str = "placeholder") -> Column:
    """text with each span (start, end, replacement; ascending, disjoint) put in its place."""
    raw = text.cast("binary")
    end = lambda s, i: F.coalesce(F.get(s, i)["end"], F.lit(0))
    gap = lambda a, n: F.substring(raw, a + 1, n).cast("string")
    parts = lambda s: F.transform(s, lambda x, i: F.concat(gap(end(s, i - 1), x["start"] - end(s, i - 1)), x[replacement]))
    last = lambda s: gap(end(s, F.size(s) - 1), F.octet_length(raw))
    return F.when(F.size(spans) > 0, let(spans, lambda s: F.concat(F.array_join(parts(s), ""), last(s)))).otherwise(text)
