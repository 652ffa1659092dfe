"""Detection that Columns can't express: patterns whose capture group is nested, optional or one of several, and many keywords at once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F, types as T

from ..sources.rules import java_pattern
from .python_columns import small_batches


#: POSIX classes, and ASCII classes that Python's own would take more for, as they stand inside brackets.
PYTHON_CLASSES = {"Alpha": "a-zA-Z", "Digit": "0-9", "Alnum": "a-zA-Z0-9", "Upper": "A-Z", "Lower": "a-z", "Punct": r"!-/:-@\[-`{-~", "XDigit": "0-9a-fA-F", "Blank": r" \t", "Cntrl": r"\x00-\x1f\x7f", "Graph": "!-~", "Print": " -~", "ASCII": r"\x00-\x7f"}
ASCII_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}


def python_pattern(pattern: str):
    """RE2's meaning in Python, on text: $ ends the text, \\d, \\w, \\s and \\b are ASCII, flags hold to the end of their group.

    Flags set inside a group become a group of their own, which is opened again behind each bar.
    """
    java = java_pattern(pattern).removeprefix("(?d)")
    out, i, in_class, class_at, opened = [], 0, False, 0, [[]]
    while i < len(java):
        c = java[i]
        if c == "\\":
            named = re.match(r"\\([pP])\{(\w+)\}", java[i:])
            e = java[i + 1]
            if named and named[2] in PYTHON_CLASSES:
                inner = PYTHON_CLASSES[named[2]]
                out.append(inner if in_class and named[1] == "p" else f"[{'^' if named[1] == 'P' else ''}{inner}]")
                if in_class and named[1] == "P":
                    raise re.error("a class can't hold a negated POSIX class here")
            elif named:
                out.append(named[0])
            elif e in "dwsDWS":
                inner, negated = ASCII_CLASSES[e.lower()], e.isupper()
                if in_class and negated:  # the whole bracket reads ASCII
                    out.insert(class_at, "(?a:")
                    in_class = "ascii"
                out.append("\\" + e if in_class and negated else inner if in_class else f"[{'^' if negated else ''}{inner}]")
            else:
                out.append({"z": r"\Z"}.get(e, "\\" + e))
            i += len(named[0]) if named else 2
            continue
        if in_class:
            out.append("])" if c == "]" and in_class == "ascii" else c)
            in_class = in_class if c != "]" else False
        elif c == "[":
            in_class, class_at = True, len(out)
            m = re.match(r"\[\^?(?:\\\])?", java[i:])
            out.append(m[0])
            i += m.end()
            continue
        elif flags := re.match(r"\(\?([a-z]*)(-[a-z]+)?\)", java[i:]):
            opened[-1].append(f"(?{flags[1].replace('u', '')}{flags[2] or ''}:")
            out.append(opened[-1][-1])
            i += flags.end()
            continue
        elif c == "(":
            m = re.match(r"\(\?<(?![=!])|\(\?[a-z]*(?:-[a-z]+)?:|\((?:\?<?[=!])?", java[i:])
            out.append("(?P<" if m[0] == "(?<" else m[0].replace("u", "") if m[0].endswith(":") else m[0])
            opened.append([])
            i += m.end()
            continue
        elif c in "|)":
            out.append(")" * len(opened[-1]) + c)
            if c == ")":
                opened.pop()
            else:
                out += opened[-1]
        else:
            out.append(c)
        i += 1
    made = "".join(out) + ")" * len(opened[0])
    if re.search(r"\\[pP]", made):
        import regex

        return regex.compile(made)
    return re.compile(made)


def matches(compiled, text: str):
    """Matches from left to right; behind an empty one the search goes on at the next character, as RE2's does."""
    at = 0
    while at <= len(text) and (m := compiled.search(text, at)):
        yield m
        at = m.end() + (m.end() == m.start())


CANDIDATES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end", "priority", "rule_ord") else T.StringType()) for n in ("start", "end", "category", "priority", "source", "rule_ord", "original")]))


class Found:
    """Candidates of a batch's rows as columns: a number each for start, end and kind (category, priority, source, rule_ord), and the original."""

    def __init__(self, kinds: list[tuple[str, int, str, int]]):
        self.kinds, self.bounds, self.start, self.end, self.kind, self.original = kinds, array("i", [0]), array("i"), array("i"), array("i"), []

    def put(self, start: int, end: int, kind: int, original: str) -> None:
        self.start.append(start)
        self.end.append(end)
        self.kind.append(kind)
        self.original.append(original)

    def arrow(self) -> pa.Array:
        numbers = lambda values: pa.array(np.array(values, np.int32), pa.int32())
        kind = numbers(self.kind)
        category, priority, source, rule_ord = (pa.array([k[i] for k in self.kinds], t).take(kind) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32())))
        columns = [numbers(self.start), numbers(self.end), category, priority, source, rule_ord, pa.array(self.original, pa.string())]
        return pa.ListArray.from_arrays(numbers(self.bounds), pa.StructArray.from_arrays(columns, CANDIDATES.elementType.names))


def candidates_udf(kinds: list[tuple[str, int, str, int]], search: Callable[[str, int, Callable[[int, int, int, str], None]], None]):
    """A UDF from segments (off, seg) to candidates; search() puts those of one segment. Batches are small, as a text may hold many times its size in hits."""
    small_batches(SparkSession.active())

    def hits(segments: pa.Array) -> pa.Array:
        found, bounds = Found(kinds), segments.offsets.to_pylist()
        off, seg = (segments.values.field(n).to_pylist() for n in ("off", "seg"))
        for a, b in zip(bounds, bounds[1:]):
            for i in range(a, b):
                search(seg[i], off[i], found.put)
            found.bounds.append(len(found.start))
        return found.arrow()

    return F.arrow_udf(hits, CANDIDATES)


def keyword_hits_udf(keywords: list[tuple[str, str, int, str, int]]):
    """A UDF from segments (off, seg) to candidates of all keywords (text, category, priority, source, rule_ord), in one pass of an automaton.

    Of one keyword leftmost occurrences that don't overlap; those of different keywords may.
    """
    same: dict[str, list[int]] = {}
    for k, (text, *_) in enumerate(keywords):
        same.setdefault(text, []).append(k)
    built: list = []

    def search(seg: str, off: int, put: Callable[[int, int, int, str], None]) -> None:
        import ahocorasick

        if not built:
            automaton = ahocorasick.Automaton()
            for text, numbers in same.items():
                automaton.add_word(text, (text, numbers))
            automaton.make_automaton()
            built.append(automaton)
        free, at, counted, plain = {}, 0, 0, seg.isascii()
        for last, (text, numbers) in sorted(built[0].iter(seg), key=lambda m: m[0] - len(m[1][0])):
            first = last + 1 - len(text)
            if first < free.get(text, 0):
                continue
            free[text] = last + 1
            if not plain:  # bytes before this one, from those before the one before
                at += len(seg[counted:first].encode())
                counted = first
            begin = off + (first if plain else at)
            for k in numbers:
                put(begin, begin + len(text.encode()), k, text)

    return candidates_udf([k[1:] for k in keywords], search)


def regex_hits_udf(pattern: str, category: str, priority: int, source: str, rule_ord: int):
    """A UDF from segments (off, seg) to candidates: of group 1 if it took part in a match, else of the match."""
    compiled = python_pattern(pattern)

    def search(seg: str, off: int, put: Callable[[int, int, int, str], None]) -> None:
        at, counted, plain = off, 0, seg.isascii()
        for m in matches(compiled, seg):
            a, b = m.span(1) if compiled.groups and m.start(1) >= 0 else m.span()
            if a < b:
                at += a - counted if plain else len(seg[counted:a].encode()) if a >= counted else -len(seg[a:counted].encode())
                counted = a
                put(at, at + (b - a if plain else len(seg[a:b].encode())), 0, seg[a:b])

    return candidates_udf([(category, priority, source, rule_ord)], search)
