"""License notices in texts: exact phrases, and near ones by pigeonhole seeds and bounded-error matching.

A phrase that may differ by k edits is split into k + 1 pieces; wherever the phrase stands with k
edits at most, one piece stands unchanged. Pieces are looked for exactly; around each one found, the
regex library matches the phrase with a bounded number of errors and says how many.

Words are runs of letters, digits and non-ASCII characters, ASCII letters in lower case; matching is
on words joined by single blanks, so punctuation and white space never count as edits.

Null and empty texts have no words and no notices. Each row is judged on its own, so repeated rows,
ties and empty tables need no rule.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import PLAIN_WORDS, append_columns

#: Phrases and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices that are looked for beside them: names of licences and sentences that stand at the head of files.
NOTICES = (
    ("bsd license", "bsd"), ("bsd 2 clause license", "bsd"), ("bsd 3 clause license", "bsd"), ("redistribution and use in source and binary forms", "bsd"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"),
    ("lesser general public license", "lgpl"), ("affero general public license", "agpl"), ("isc license", "isc"), ("boost software license", "bsl"), ("creative commons attribution", "cc-by"), ("creative commons zero", "cc0"),
    ("creative commons license", "cc"), ("permission is hereby granted free of charge to any person obtaining a copy", "mit"), ("permission to use copy modify and or distribute this software", "isc"), ("licensed under the apache license version 2 0", "apache"),
    ("this is free and unencumbered software released into the public domain", "unlicense"), ("all rights reserved", "reserved"),
)
#: Identifiers, which an edit would make another's.
IDENTIFIERS = tuple((f"spdx license identifier {name}", label) for name, label in (("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("agpl 3 0", "agpl"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("mpl 2 0", "mpl"), ("epl 2 0", "epl"), ("isc", "isc"), ("unlicense", "unlicense")))
#: Characters of a phrase, and of a notice, for each edit that it may have.
CHARS_PER_EDIT, CHARS_PER_NOTICE_EDIT = 10, 12
NOTICE = T.ArrayType(T.StructType([T.StructField(k, T.StringType() if k == "label" else T.IntegerType(), False) for k in ("label", "first_word", "end_word", "start", "end", "edits")]), False)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrase:
    def __init__(self, phrase: str, label: str, chars_per_edit: int):
        self.phrase, self.label, self.edits = phrase, label, len(phrase) // chars_per_edit
        cuts = [len(phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.seed_bytes = [s.encode() for _, s in self.seeds]
        self.near = regex.compile(rf"(?b)(?<= )(?:{regex.escape(phrase, literal_spaces=True)}){{e<={self.edits}}}(?= )")

    def found(self, words: bytes, decoded: list[str]) -> list[tuple[int, int, int]]:
        """Places (start, end, edits) in words, which begin and end with a blank; decoded caches them as str."""
        if not any(s in words for s in self.seed_bytes):
            return []
        if not decoded:
            decoded.append(words.decode("utf-8", "replace"))
        text, places = decoded[0], {}
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                begin = max(0, at - offset - self.edits - 1)
                stop = at - offset + len(self.phrase) + self.edits + 1
                for m in self.near.finditer(text[begin:stop], overlapped=True):
                    a, b = begin + m.start(), begin + m.end()
                    if text[a] != " " and text[b - 1] != " ":
                        places[a] = min(places.get(a, (9, 0)), (sum(m.fuzzy_counts), b))
                at = text.find(seed, at + 1)
        return [(a, b, e) for a, (e, b) in sorted(places.items())]


def exact_starts(words: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase's words stand consecutively."""
    starts, at, counted, n = [], words.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        n += words.count(b" ", counted, at)
        counted = at
        starts.append(n)
        at = words.find(b" " + phrase + b" ", at + 1)
    return starts


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, chars_per_edit: int = CHARS_PER_EDIT, keep: list[str] | None = None, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_notice_edit: int = CHARS_PER_NOTICE_EDIT, identifiers: tuple[tuple[str, str], ...] = IDENTIFIERS) -> DataFrame:
    """The columns `keep` (default: all) of docs, n_words, base (starts of exact phrases with labels), notices and score.

    phrases make base and, with edits, notices; the list `notices` makes notices alone, and so does `identifiers`, without edits. notices: label, words [first_word, end_word), characters [start, end) of the text, and edits. score: 1 less the share of edited characters of the best notice, 0 without one.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType(), False), T.StructField("word", T.IntegerType(), False)]), False)), T.StructField("notices", NOTICE), T.StructField("score", T.DoubleType())]
    compiled: list[Phrase] = []
    more = tuple(notices)

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        if not compiled:
            compiled.extend(Phrase(p, label, chars_per_edit) for p, label in phrases)
            compiled.extend(Phrase(p, label, chars_per_notice_edit) for p, label in more)
            compiled.extend(Phrase(p, label, len(p) + 1) for p, label in identifiers)
        counts, bases, found, scores = [], [], [], []
        for text in texts:
            split = text.translate(PLAIN_WORDS).split() if text else []
            counts.append(len(split))
            words, decoded, base, near, score = b" " + b" ".join(split) + b" ", [], [], [], 0.0
            for k, p in enumerate(compiled):
                if k < len(phrases):
                    base += [{"label": p.label, "word": w} for w in exact_starts(words, p.phrase.encode())]
                for a, b, e in p.found(words, decoded):
                    first = decoded[0].count(" ", 0, a) - 1
                    near.append({"label": p.label, "first_word": first, "end_word": first + decoded[0].count(" ", a, b) + 1, "edits": e})
                    score = max(score, 1 - e / len(p.phrase))
            if near:
                spans = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
                near = [n | {"start": spans[n["first_word"]][0], "end": spans[n["end_word"] - 1][1]} for n in near]
            bases.append(base)
            found.append(near)
            scores.append(score)
        return [pa.array(counts, pa.int64()), pa.array(bases, pa.list_(pa.struct([pa.field("label", pa.string(), False), pa.field("word", pa.int32(), False)]))), pa.array(found, pa.list_(pa.struct([pa.field(f.name, pa.string() if f.name == "label" else pa.int32(), False) for f in NOTICE.elementType.fields]))), pa.array(scores, pa.float64())]

    return append_columns(docs, text_col, fields, compute, keep)
