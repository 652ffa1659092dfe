"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is an Arrow batch of documents. Its words are mapped to the phrases' vocabulary; any other
word ends a run, and runs shorter than the shortest phrase can't hold one. What is left is indexed:
a suffix array (prefix doubling) gives the Burrows-Wheeler transform, a wavelet matrix gives ranks.
All phrases are searched backward together, a word at a time; occurrences are located by walking to
the next sampled suffix position. Occurrences become spans of words, merged for each document.

Null or empty texts have no words. Null or empty benchmark texts have no windows; benchmark rows
without an item_id are one item, listed last as null. Rows with the same item_id are one item. Documents
are rows: repeated ones are judged alike, each on its own. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import PLAIN_WORDS, append_columns, deleted, stored

WINDOW = 13
#: A document is contaminated if this share of its words is hit.
SHARE = 20
#: Benchmark text that one pass over the documents searches for; more takes more passes.
BLOCK_BYTES = 8 << 20
#: Pieces of long items have a word for so many bytes of a block.
PIECE_SHARE = 256
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distance of sampled suffix positions.
SAMPLE = 16
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split() if text else []


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols; access(i)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, cur = [], symbols.astype(np.int32)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = ((cur >> bit) & 1).astype(np.uint8)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, before, len(cur) - int(ones.sum())))
            cur = np.concatenate([cur[ones == 0], cur[ones == 1]])

    @staticmethod
    def ones_before(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for bit, packed, before, zeros in self.levels:
            s1, e1, one = self.ones_before(packed, before, start), self.ones_before(packed, before, end), ((c >> bit) & 1).astype(bool)
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for bit, packed, before, zeros in self.levels:
            one = (packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            s1 = self.ones_before(packed, before, i)
            c |= one.astype(np.int64) << bit
            i = np.where(one, zeros + s1, i - s1)
        return c


class FMIndex:
    """Of symbols from 1; 0 ends a run, and the text begins and ends with one."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        # ends of runs are ordered by place, so that no comparison goes beyond a run
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        base = max(n, sigma + len(ends)) + 1  # above any second rank: a short text of a large vocabulary has symbols beyond n
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * base + second
            order = np.argsort(key)
            changed = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
            rank[order] = np.cumsum(changed)
            if int(changed.sum()) == n - 1:
                break
            step *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        # the first of each run is sampled: walks then never pass an end
        sampled = (np.arange(n) % SAMPLE == 0) | (text == 0) | np.concatenate([[True], text[:-1] == 0])
        self.marked = sampled[order]
        self.sample_at = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]
        self.n = n

    def search(self, stream: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern: `lengths` symbols of stream from `first`."""
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        live = np.arange(len(first))
        for k in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            c = stream[first[live] + lengths[live] - k].astype(np.int64)
            low[live], high[live] = self.first[c] + self.bwt.rank(c, low[live]), self.first[c] + self.bwt.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, rows, open_ = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(open_ := open_[~self.marked[rows[open_]]]):
            c = self.bwt.access(rows[open_])
            rows[open_] = self.first[c] + self.bwt.rank(c, rows[open_])
            steps[open_] += 1
        return self.samples[self.sample_at[rows]] + steps


@dataclass
class Phrases:
    """Distinct windows of a block of benchmark items, as places in the stream of the items' words."""

    vocabulary: dict[bytes, int]
    stream: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    #: the items of window k are items[item_at[k]:item_at[k + 1]], numbers of names
    items: np.ndarray
    item_at: np.ndarray
    names: list[str | None]


def phrases_of(items: list[tuple[object, bytes | None]], window: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    names: dict[object, int] = {}
    coded = [(names.setdefault(item, len(names)), np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)) for item, text in items]
    coded = [(k, ids) for k, ids in coded if len(ids)]
    size = np.array([len(ids) for _, ids in coded], np.int64)
    stream = np.concatenate([np.zeros(0, np.int32), *[ids for _, ids in coded]])
    count = np.maximum(1, size - window + 1)
    first = np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count) + np.arange(count.sum())
    lengths = np.repeat(np.minimum(size, window), count)
    owner = np.repeat(np.array([k for k, _ in coded], np.int64), count)
    # equal windows side by side: rows of their words, padded with 0, in order
    padded = np.append(stream, np.zeros(window, np.int32))
    rows = np.stack([np.where(lengths > k, padded[first + k], 0) for k in range(window)], 1) if len(first) else np.zeros((0, window), np.int32)
    order = np.lexsort([owner, *rows.T[::-1]])
    rows, owner = rows[order], owner[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(1))[:len(rows)]
    own = new | np.append(True, owner[1:] != owner[:-1])[:len(rows)]
    number = np.cumsum(new) - 1
    return Phrases(vocabulary, stream, first[order][new], lengths[order][new], owner[own].astype(np.int32), np.searchsorted(number[own], np.arange(int(new.sum()) + 1)), [None if x is None else str(x) for x in names])


def find_in_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """Of each text: its number of words, the merged spans of hit words (rows first, end), and the items."""
    get = phrases.vocabulary.get
    counts, parts = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):
        words = words_of(text)
        counts[k] = len(words)
        parts += map(get, words)
        parts.append(None)
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
    items: list[set[int]] = [set() for _ in texts]
    if not len(phrases.lengths) or not parts:
        return counts, spans, items
    symbols = np.array([0 if p is None else p for p in parts], np.int32)
    del parts
    # keep runs that can hold a phrase
    ends = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    long_enough = ends - starts >= int(phrases.lengths.min())
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return counts, spans, items
    sizes = ends - starts + 1
    at = np.concatenate([[1], 1 + np.cumsum(sizes)])
    text = np.concatenate([[0], symbols[np.repeat(starts - at[:-1], sizes) + np.arange(1, at[-1])]])
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.stream, phrases.first, phrases.lengths)
    n = np.maximum(high - low, 0)
    if not n.sum():
        return counts, spans, items
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place = index.locate(rows)
    run = np.searchsorted(at, place, "right") - 1
    place += starts[run] - at[run]
    doc_start = np.concatenate([[0], np.cumsum(counts + 1)])
    doc = np.searchsorted(doc_start, place, "right") - 1
    first = place - doc_start[doc]
    order = np.lexsort((first, doc))
    doc, first, which = doc[order], first[order], which[order]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        end = np.maximum.accumulate(first[a:b] + phrases.lengths[which[a:b]])
        new = np.concatenate([[True], first[a + 1:b] > end[:-1]])
        spans[doc[a]] = np.stack([first[a:b][new], end[np.concatenate([new[1:], [True]])]], 1)
        items[doc[a]] = {i for w in set(which[a:b].tolist()) for i in phrases.items[phrases.item_at[w]:phrases.item_at[w + 1]].tolist()}
    return counts, spans, items


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int) -> tuple[int, Iterator[list[tuple[object, bytes]]]]:
    """How many blocks of about block_bytes the benchmark makes, and these. Long items are cut into pieces that share window - 1 words."""
    rows = benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].cast("string").alias("t")).filter("t is not null").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    if n == 1:
        return 1, ([(r.i, r.t.encode()) for r in part.collect()] for part in [rows])
    step = max(1, block_bytes // PIECE_SHARE)
    words = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD_PATTERN), F.lit(0)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
    pieces = words.select("i", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, step + window - 1), " "))).alias("piece", "t"))
    parts = (pieces.filter(F.pmod(F.xxhash64("i", "piece", F.col("t")), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, r.t.encode()) for r in part.collect()] for part in parts)


def shard_columns(texts: list[bytes | None], phrases: Phrases) -> list[pa.Array]:
    counts, spans, items = find_in_shard(texts, phrases)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
    flat = np.concatenate(spans)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32())], fields=[pa.field("first", pa.int32(), False), pa.field("end", pa.int32(), False)])
    names = [sorted({phrases.names[i] for i in s}, key=lambda x: (x is None, x)) for s in items]
    return [pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array(names, pa.list_(pa.string()))]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs, n_words, spans (merged, of words, half open), items (sorted strings), n_hit and contaminated."""
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes, window)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"n_words", "spans", "items", "n_hit", "contaminated"}]
    carried = "benchmarked_text"
    while carried in kept:
        carried += "_"
    out = docs if n == 1 else docs.select(*[docs[c] for c in kept], docs[text_col].alias(carried))
    before = None
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(phrases_of(block, window))
        if k:
            out = stored(out.withColumnsRenamed({"spans": "spans_before", "items": "items_before"}), "decontamination")
            if before:
                deleted(docs.sparkSession, before)
            before = out.stored_at
        out = append_columns(out, text_col if n == 1 else carried, fields, lambda texts, shared=shared: shard_columns(texts, shared.value), kept if n == 1 else None)
        if k:
            out = out.withColumns({"spans": merged(F.concat("spans_before", "spans")), "items": F.array_sort(F.array_union("items_before", "items"))}).drop("spans_before", "items_before")
    out = out.drop(carried).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def merged(spans):
    """Overlapping or touching spans joined, as find_in_shard() joins them."""
    ordered = F.array_sort(spans)
    empty = F.lit([]).cast(SPANS)
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(ordered, empty, lambda acc, s: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= s["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at:places[first][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
