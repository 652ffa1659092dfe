"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

A document's set is its distinct five-word shingles. Sets of similar size share a band. For sets of a
band the universe of shingle hashes is cut into m segments. Two linked sets differ in H shingles at
most, and each shingle lies in one segment, so some segment holds the same part of both sets if
m > H. Each non-empty part is hashed with band and segment into a signature. In the first G segments
the parts with one shingle deleted are signatures too, so there parts that differ by one shingle
match, and such a segment counts twice. m and G of a band are those with the least expected number of
signatures that leave room for empty segments and crowded signatures.

Only signatures that several documents share matter. Of a group of up to CROWD documents all pairs
are compared that aren't connected yet. Crowded signatures are skipped by documents with room for
that. Of the others, a crowded signature links its documents to two of them; if
that leaves it in several components, it is skipped, and counts against the room of each of its
documents. A document without room left for what was skipped may have missed a partner that has none
either, and both have a skipped signature in common (or had no room from the start). Such documents,
clustered by skipped signatures, are compared in blocks: those outside a cluster's main component
with all of the cluster. Blocks hold sizes and sketches, and only pairs that these don't rule out are
verified; blocks of documents too long for a sketch to tell hold texts. So no link is lost, and near
copies that are connected already are never compared pair by pair.

Before two documents are compared, sizes and parity sketches rule most others out: each shingle flips
one of SKETCH bits, so bits that differ are no more than shingles that differ.

Links are verified on the words themselves. Shingles are told apart by 64-bit hashes when counted.

Exact copies (same words) are one set. Documents without words, or null, have n_shingles 0 and link
with nothing. Rows that share a doc_id are one node with several texts, and each row is returned. A
null doc_id can't be named: such rows have component_id null. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import in_tasks, scratch, small_batches, stored, text_bytes

NGRAM = 5
#: Links: DEN x intersection >= NUM x union. Linked sets differ in (DEN - NUM) / (DEN + NUM) of both sizes' sum at most.
NUM, DEN = 80, 100
#: Groups of more documents are crowded.
CROWD = 16
#: Documents on each side of a block comparison, by sketches and by texts.
BLOCK, TEXT_BLOCK = 1024, 32
#: Sketches tell sets of up to so many shingles apart; longer ones are compared by texts.
TOLD_APART = 2000
#: Shingles of texts whose sets a verifying task remembers.
REMEMBERED = 200_000
#: Bits of a parity sketch.
SKETCH = 1024
#: Hashes of words that are remembered.
MEMORY = 150_000
#: Rows and bytes of a shard, whose words and signatures a task holds at once.
SHARD = (1500, 5 << 20)
#: Signatures that one bucket is planned for.
BUCKET = 1_000_000
#: Ids are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000
#: Room that is left: standard deviations of the number of empty segments, share of crowded signatures.
ROOM = (4.5, 0.10)
META = np.dtype([("doc", "<i8"), ("null", "?"), ("n", "<i4"), ("room", "<i4"), ("key", "u1", 16), ("sketch", "u1", SKETCH // 8)])
MIX1, MIX2, MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x + MIX3
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def most_different(total: np.ndarray | int) -> np.ndarray | int:
    """Symmetric difference of linked sets whose sizes add up to total."""
    return total * (DEN - NUM) // (DEN + NUM)


def band_starts(largest: int) -> list[int]:
    """Sizes at which bands begin; linked sets are in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * DEN // NUM + 1)
    return starts


@lru_cache(maxsize=None)
def allocation(first: int, end: int, deviations: float, crowded: float) -> tuple[int, int]:
    """Segments m and, of these, segments G with one-deletion neighbourhoods, for a band [first, end) of sizes."""
    size = end - 1
    h = int(most_different(size + size * DEN // NUM))
    best = (math.inf, 1, 0)
    for m in range(1, 2 * h + 4):
        t = size / m
        empty = math.exp(-t) if m > 1 else 0.0
        need = h + 1
        if m > 1:
            need += m * empty + deviations * math.sqrt(m * empty * (1 - empty)) + crowded * m
        g = max(0, math.ceil((need - m) / max(1e-9, 1 - empty * (1 + t) if m > 1 else 1.0)))
        if g <= m and (cost := m * (1 - empty) + g * t) < best[0]:
            best = (cost, m, g)
    return best[1:]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingle_sets(all_words: list[list[bytes]], seed: int, memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each begins (and the end)."""
    n = np.fromiter(map(len, all_words), np.int64, len(all_words))
    flat = np.fromiter(map(memory.__getitem__, chain.from_iterable(all_words)), np.uint64, int(n.sum()))
    at = np.concatenate([[0], np.cumsum(n)])
    padded = np.concatenate([mix(flat), np.zeros(NGRAM - 1, np.uint64)])
    h = np.zeros(len(flat), np.uint64)
    for k in range(NGRAM):
        h = mix(h + padded[k:k + len(flat)])
    for d in np.flatnonzero((n > 0) & (n < NGRAM)):
        x = np.zeros(1, np.uint64)
        for k in range(int(n[d])):
            x = mix(x + padded[at[d] + k:at[d] + k + 1])
        h[at[d]] = mix(x + np.uint64(n[d]))[0]
    count = np.where(n >= NGRAM, n - NGRAM + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    sets = mix(h[np.repeat(at[:-1] - starts[:-1], count) + np.arange(starts[-1])] ^ np.uint64(seed))
    for a, b in zip(starts[:-1], starts[1:]):
        sets[a:b].sort()
    new = np.ones(len(sets), bool)
    new[1:] = sets[1:] != sets[:-1]
    new[starts[:-1][count > 0]] = True
    return sets[new], np.concatenate([[0], np.cumsum(new)])[starts]


def signatures(sets: np.ndarray, starts: np.ndarray, deviations: float, crowded: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their documents (numbers), and each document's room."""
    size = np.diff(starts)
    docs = np.flatnonzero(size)
    room = np.full(len(size), np.iinfo(np.int32).max, np.int64)
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), room
    bands = np.array(band_starts(int(size.max())))
    own = np.searchsorted(bands, size[docs], "right") - 1
    plan = np.array([allocation(int(a), int(b), deviations, crowded) for a, b in zip(bands[:-1], bands[1:])] or [(1, 0)])
    out_sig, out_doc = [], []
    token, parts = mix(sets), np.repeat(np.arange(len(size)), size)
    for below in (0, 1):  # in its own band with all; in the one below with the smaller sets there
        live = docs[own >= below]
        if not len(live):
            continue
        band = np.zeros(len(size), np.int64)
        band[live] = own[own >= below] - below
        chosen = np.zeros(len(size), bool)
        chosen[live] = True
        m, g = plan[band, 0], plan[band, 1]
        rows = chosen[parts]
        d, h, w = parts[rows], sets[rows], token[rows]
        segment = ((h >> np.uint64(32)) * m[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (segment[1:] != segment[:-1])]))
        length = np.diff(np.append(begin, len(d)))
        total, place = np.add.reduceat(w, begin), mix((band[d[begin]].astype(np.uint64) << np.uint64(32)) + segment[begin].astype(np.uint64))
        out_sig.append(mix(total + place))
        out_doc.append(d[begin])
        double = (segment[begin] < g[d[begin]]) & (length > 1)
        if double.any():
            pick = np.flatnonzero(np.repeat(double, length))
            of = np.repeat(np.arange(len(begin)), length)[pick]
            out_sig.append(mix(total[of] - w[pick] + place[of]))
            out_doc.append(d[pick])
        held = np.bincount(d[begin], minlength=len(size)) + np.bincount(d[begin][double], minlength=len(size))
        partner = np.minimum(size * DEN // NUM, bands[band + 1] - 1) if below else size * DEN // NUM
        left = held - most_different(size + partner) - 1
        room[live] = np.minimum(room[live], left[live])
    return np.concatenate(out_sig), np.concatenate(out_doc), room


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes by significance, which compress better."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((8, len(data) // width), np.uint8)
    out[:width] = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


PACKED = "bucket int, sigs binary, docs binary, meta binary, crowds binary"
GROUPS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("room", T.IntegerType()), T.StructField("key", T.BinaryType()),
    T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("sig", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("kind", T.IntegerType()),
])
IS_META, IS_SMALL, IS_CROWDED = 0, 1, 2


def groups_of(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, doc) in order, and where each sig's rows begin (and the end)."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, doc = sig[new], doc[new]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return sig, doc, np.append(begin, len(sig))


def sketches(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parity sketches of each document, as bytes."""
    size = np.diff(starts)
    cell = np.repeat(np.arange(len(size)), size) * SKETCH + (mix(sets) >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64)
    odd = np.bincount(cell, minlength=len(size) * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(size), SKETCH), axis=1)


def shard(ids: list[int | None], texts: list[bytes | None], seed: int, level: tuple[float, float], buckets: int, memory: WordHashes) -> pa.RecordBatch:
    words = [words_of(t) for t in texts]
    key = [hashlib.sha256(b" ".join(w)).digest()[:16] for w in words]
    first: dict[bytes, int] = {}
    for k, i in enumerate(ids):  # of exact copies here, the smallest id speaks for all
        if i is not None and (key[k] not in first or i < ids[first[key[k]]]):
            first[key[k]] = k
    sets, starts = shingle_sets(words, seed, memory)
    n = np.diff(starts)
    speaks = np.zeros(len(ids), bool)
    speaks[list(first.values())] = True
    sig, doc, room = signatures(sets, starts, *level)
    keep = speaks[doc]
    number = np.array([-1 if i is None else i for i in ids], np.int64)
    sig, doc = sig[keep], number[doc[keep]]
    # of the documents that crowd a signature here, so many go on that it is seen to be crowded; all are told apart as a crowd
    order = np.argsort(sig)
    s = sig[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(s)))
    many = np.repeat(length > CROWD, length)
    crowd_sig, crowd_doc, crowd_at = groups_of(s[many], doc[order][many].astype(np.uint64))
    few = np.arange(len(crowd_sig)) - np.repeat(crowd_at[:-1], np.diff(crowd_at)) <= CROWD
    sig = np.concatenate([s[~many], crowd_sig[few]])
    doc = np.concatenate([doc[order][~many], crowd_doc[few].astype(np.int64)])
    bucket = (sig >> np.uint64(33)).astype(np.int64) * buckets >> 31
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sig, doc = sig[order], doc[order].astype(np.uint64)
    meta = np.zeros(len(ids), META)
    meta["doc"], meta["null"], meta["n"], meta["room"] = number, [i is None for i in ids], n, np.minimum(room, np.iinfo(np.int32).max)
    meta["key"], meta["sketch"] = np.frombuffer(b"".join(key), np.uint8).reshape(-1, 16), sketches(sets, starts)
    rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    home = int.from_bytes(key[0][:4], "little") % buckets
    columns = [rows + [home], [planes(sig[cuts[b]:cuts[b + 1]], 8) for b in rows] + [None], [planes(doc[cuts[b]:cuts[b + 1]], 8) for b in rows] + [None], [None] * len(rows) + [meta.tobytes()],
               [None] * len(rows) + [planes(crowd_sig, 8) + planes(crowd_doc, 8)]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "sigs", "docs", "meta", "crowds"])


def bucket_groups(table: pa.Table) -> pa.Table:
    """Of a bucket: its groups of several documents; rows of META and of crowds pass through."""
    out: dict[str, list] = {f.name: [] for f in GROUPS.fields}

    def add(count: int, kind: int, **columns) -> None:
        for name in out:
            out[name] += [kind] * count if name == "kind" else columns.get(name) or [None] * count

    sigs, docs = [], []
    for s, d, m, c in zip(*(table.column(k).to_pylist() for k in ("sigs", "docs", "meta", "crowds"))):
        if s is not None:
            sigs.append(from_planes(s, 8))
            docs.append(from_planes(d, 8))
        if m is not None:
            meta = np.frombuffer(m, META)
            add(len(meta), IS_META, doc=[None if x else y for x, y in zip(meta["null"].tolist(), meta["doc"].tolist())], n=meta["n"].tolist(), room=meta["room"].tolist(), key=[x.tobytes() for x in meta["key"]], sketch=np.ascontiguousarray(meta["sketch"]).view("<i8").tolist())
        if c:
            half = len(c) // 2
            sig, doc, at = groups_of(from_planes(c[:half], 8), from_planes(c[half:], 8))
            lead = np.repeat(doc[at[:-1]], np.diff(at)).astype(np.int64)
            add(len(sig), IS_CROWDED, sig=sig.view(np.int64).tolist(), members=np.stack([lead, doc.astype(np.int64)], 1).tolist())
    if sigs:
        sig, doc, at = groups_of(np.concatenate(sigs), np.concatenate(docs))
        length = np.diff(at)
        small = {tuple(doc[at[k]:at[k + 1]].astype(np.int64).tolist()) for k in np.flatnonzero((length > 1) & (length <= CROWD))}
        add(len(small), IS_SMALL, members=[sorted(x) for x in small])
        many = np.repeat(length > CROWD, length)
        lead = np.repeat(doc[at[:-1]], length)[many].astype(np.int64)
        add(int(many.sum()), IS_CROWDED, sig=sig[many].view(np.int64).tolist(), members=np.stack([lead, doc[many].astype(np.int64)], 1).tolist())
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int32())
    return pa.table([pa.array(out[f.name], k) for f, k in zip(GROUPS.fields, kinds)], names=GROUPS.names)


def candidate_groups(rows: DataFrame, seed: int, level: tuple[float, float]) -> DataFrame:
    """Rows of GROUPS for documents (i, x)."""
    spark = rows.sparkSession
    small_batches(spark, *SHARD)
    size = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 * BUCKET)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            if batch.num_rows:
                yield shard(batch.column(0).to_pylist(), text_bytes(batch.column(1)), seed, level, buckets, memory)

    packed = rows.mapInArrow(in_tasks(run), PACKED)
    return stored(packed.groupBy("bucket").applyInArrow(bucket_groups, GROUPS), "groups", ("kind",))


def beside(ids: DataFrame, *columns: Column, most: int = BROADCAST_IDS) -> DataFrame:
    """Columns of a stored table of ids, for a join: broadcast if its rows, counted once, are few."""
    if not hasattr(ids, "counted"):
        ids.counted = ids.count()
    chosen = ids.select(*columns)
    return F.broadcast(chosen) if ids.counted <= most else chosen


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows whose column is in ids (a stored table with column `id`)."""
    return rows.join(beside(ids, F.col("id").alias("wanted_id")), F.col(column) == F.col("wanted_id"), "left_semi")


def renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b) with each id replaced by its name (id, name), in order, distinct."""
    for c in ("a", "b"):
        pairs = pairs.join(beside(names, F.col("id").alias("id_"), F.col("name").alias("name_")), F.col(c) == F.col("id_"), "left").withColumn(c, F.coalesce("name_", c)).drop("id_", "name_")
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_set(text: bytes) -> frozenset:
    w = words_of(text)
    return frozenset(zip(*(w[k:] for k in range(NGRAM)))) if len(w) >= NGRAM else frozenset([tuple(w)]) if w else frozenset()


class ExactSets(dict):
    """Sets of texts, as many as REMEMBERED shingles allow."""

    held = 0

    def __missing__(self, text: bytes) -> frozenset:
        made = exact_set(text)
        if self.held + len(made) > REMEMBERED:
            self.clear()
            self.held = 0
        if len(made) <= REMEMBERED:
            self[text] = made
            self.held += len(made)
        return made


def linked(x: bytes, y: bytes, sets: ExactSets) -> bool:
    a, b = sets[x], sets[y]
    both = len(a & b)
    return bool(both) and DEN * both >= NUM * (len(a) + len(b) - both)


def may_link() -> Column:
    """Of a pair's sizes and sketches: nothing rules a link out."""
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    sizes = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
    return sizes & (differ <= F.floor((F.col("na") + F.col("nb")) * (DEN - NUM) / (DEN + NUM)))


def verified(pairs: DataFrame, figures: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The linked ones of pairs (a, b); figures: (id, n, sketch). Texts are fetched and travel only for pairs that may link."""
    with scratch() as keep:
        for c in ("a", "b"):
            pairs = pairs.join(beside(figures, F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), most=BROADCAST_IDS // 5), c)
        pairs = keep(pairs.filter(may_link()).select("a", "b").distinct(), "pairs")
        ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = keep(texts_of(ids), "texts")
        one = texts.select(F.col("id").alias("a"), F.col("x").alias("xa"))
        two = texts.select(F.col("id").alias("b"), F.col("x").alias("xb"))
        # few pairs go to the texts, which then move once for each side and not twice for one
        joined = one.join(beside(pairs, F.col("a"), F.col("b")), "a").join(two, "b").select("a", "b", "xa", "xb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = ExactSets()
            for batch in batches:
                found = [linked(x, y, sets) for x, y in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)))]
                yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

        small_batches(pairs.sparkSession)
        return stored(joined.mapInArrow(in_tasks(run), "a long, b long").distinct(), "links")


def texts_by_id(rows: DataFrame, meta: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from a stored table of ids to their texts (id, x); of ids that name several rows, distinct ones."""
    doubled = stored(meta.groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"), "doubled")
    none = doubled.isEmpty()

    def fetch(ids: DataFrame) -> DataFrame:
        found = among(rows, "i", ids).select(F.col("i").alias("id"), "x")
        if none:
            return found
        alone = found.join(beside(doubled, F.col("id")), "id", "left_anti")
        return alone.unionByName(among(found, "id", doubled).distinct())

    return fetch


def components(edges: DataFrame) -> DataFrame:
    """(id, name): for each id in edges (a, b) the smallest id reachable. Each round hooks every id to its smallest neighbour."""
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("name"))
    names, live = None, edges
    while True:
        both = live.select(F.col("a").alias("id"), F.col("b").alias("name")).unionByName(live.select(F.col("b").alias("id"), F.col("a").alias("name")))
        hooks = stored(both.groupBy("id").agg(F.min("name").alias("name")).select("id", F.least("id", "name").alias("name")), "hooks")
        while True:  # follow hooks to their ends, by halves
            up = beside(hooks, F.col("id").alias("name"), F.col("name").alias("next"))
            hooks = stored(hooks.join(up, "name").select("id", F.col("next").alias("name"), (F.col("next") != F.col("name")).alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
        if names is None:
            names = hooks.select("id", "name")
        else:
            up = beside(hooks, F.col("id").alias("name"), F.col("name").alias("next"))
            names = stored(names.join(up, "name", "left").select("id", F.coalesce("next", "name").alias("name")), "names")
        live = stored(renamed(live, hooks), "edges")
        if live.isEmpty():
            return names


def merged_names(names: DataFrame, edges: DataFrame) -> DataFrame:
    """names (id, name) after more links between names or ids."""
    up = components(stored(renamed(edges, names), "edges"))
    old = names.join(beside(up, F.col("id").alias("name"), F.col("name").alias("next")), "name", "left").select("id", F.coalesce("next", "name").alias("name"))
    # ids that had no name yet
    new = up.select("id", "name").join(beside(names, F.col("id")), "id", "left_anti")
    return stored(old.unionByName(new), "names")


def named(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Adds `name` of the id in column (the id itself if it has none)."""
    n = beside(names, F.col("id").alias("id_"), F.col("name"))
    return rows.join(n, F.col(column) == F.col("id_"), "left").drop("id_").withColumn("name", F.coalesce("name", column))


def join_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """names (id, name) by all links between documents of groups."""
    with scratch() as keep:
        meta = groups.filter(F.col("kind") == IS_META).filter("doc is not null and n > 0").select("doc", "n", "room", "key", "sketch")
        copies = meta.groupBy("key").agg(F.min("doc").alias("name"))
        copies = keep(meta.select("doc", "key").join(copies, "key").filter("doc != name").select(F.col("doc").alias("id"), "name"), "copies")
        small = keep(groups.filter(F.col("kind") == IS_SMALL).select("members").distinct(), "small")
        crowded = named(groups.filter(F.col("kind") == IS_CROWDED).select("sig", F.element_at("members", 2).alias("m")), "m", copies).select("sig", F.col("name").alias("doc")).distinct()
        crowded = keep(crowded, "crowded")
        # who has room for all its crowded signatures finds every partner by the others
        room = meta.groupBy(F.col("doc").alias("id")).agg(F.min("room").alias("room"))
        many = crowded.groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        many = keep(many.join(room, "id").filter("n > room").select("id"), "many")
        crowded = keep(among(crowded, "doc", many), "crowded")
        leads = keep(crowded.groupBy("sig").agg(F.min("doc").alias("a")), "leads")
        star = small.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", 2, CROWD)).alias("b")).unionByName(crowded.join(beside(leads, F.col("sig"), F.col("a")), "sig").select("a", F.col("doc").alias("b")))
        first = keep(renamed(star, copies), "pairs")
        # rows that share a doc_id are one node with several texts, so a document's figures are its texts' own
        no_room = meta.filter("room < 0").select(F.col("doc").alias("id"))
        ids = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select(F.col("doc").alias("id"))).unionByName(no_room).distinct()
        figures = keep(among(meta, "doc", keep(ids, "ids")).select(F.col("doc").alias("id"), "n", "sketch", "room").distinct(), "figures")
        texts_of = texts_by_id(rows, meta)
        links = verified(first, figures, texts_of)
        names = merged_names(rows.sparkSession.createDataFrame([], "id long, name long"), copies.select(F.col("name").alias("a"), F.col("id").alias("b")).unionByName(links))

        # what isn't connected yet: small groups by all pairs, crowded ones by a second document
        every = F.flatten(F.transform("members", lambda x: F.transform(F.filter("members", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        rest = apart(renamed(small.filter(F.size("members") > 2).select(F.explode(every).alias("p")).select("p.*"), copies), names)
        split = several(crowded, names)
        lead = keep(split.groupBy("sig").agg(F.min_by("doc", F.xxhash64("doc", "sig")).alias("a")), "leads")
        rest = rest.unionByName(apart(split.join(beside(lead, F.col("sig"), F.col("a")), "sig").select("a", F.col("doc").alias("b")), names))
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
        names = merged_names(names, verified(rest, figures, texts_of))

        # crowded groups that stay in several components are skipped; who has no room for them is compared in blocks
        split = several(crowded, names)
        skipped = split.groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("skipped"))
        room = figures.groupBy("id").agg(F.min("room").alias("room"))
        short = keep(room.join(skipped, "id", "left").filter(F.col("room") < F.coalesce("skipped", F.lit(0))), "short")
        if short.isEmpty():
            return names
        members = keep(clustered(short, split, names), "members")
        told = figures.filter(F.col("n") <= TOLD_APART * DEN // NUM).select("id", "n", "sketch")
        links = verified(compared_in_blocks(members.join(told, "id"), BLOCK, block_pairs), figures, texts_of)
        long = keep(members.join(figures.filter(F.col("n") > TOLD_APART).select("id").distinct(), "id"), "members")
        if not long.isEmpty():
            texts = texts_of(keep(long.select("id").distinct(), "ids"))
            links = links.unionByName(compared_in_blocks(long.join(texts, "id"), TEXT_BLOCK, block_links))
        return merged_names(names, links)


def clustered(short: DataFrame, split: DataFrame, names: DataFrame) -> DataFrame:
    """(id, cluster, apart, name): documents of short (id, room) that have a skipped signature in common, or had no room from the start; one may be in a cluster of either sort."""
    rows = split.join(beside(short, F.col("id").alias("doc")), "doc", "left_semi")
    leads = rows.groupBy("sig").agg(F.min("doc").alias("a"))
    leads = stored(leads, "leads")
    clusters = components(stored(rows.join(beside(leads, F.col("sig"), F.col("a")), "sig").select("a", F.col("doc").alias("b")).distinct(), "edges"))
    # without room from the start: a cluster for all of them
    alone = short.filter("room < 0").select("id", F.lit(-1).cast("long").alias("cluster"), F.lit(True).alias("apart"))
    return named(clusters.select("id", F.col("name").alias("cluster"), F.lit(False).alias("apart")).unionByName(alone), "id", names)


def compared_in_blocks(members: DataFrame, size: int, compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Pairs (a, b) that compare() finds between members (id, cluster, apart, name and what it compares) of different names in one cluster.

    Clusters are cut into blocks of about `size` documents; each block of those outside the main
    component meets each block of the cluster in one task. A row goes to as many tasks as there are
    blocks on the other side.
    """
    parts = members.groupBy("cluster", "apart", "name").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("cluster", "apart").agg(F.max_by("name", F.struct("k", "name")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("out")).filter("out > 0")
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    main = stored(main, "main")
    rows = members.join(beside(main, *main.columns), ["cluster", "apart"])
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    held = [*members.columns, "left", "l", "r"]
    right = rows.withColumns({"left": F.lit(False), "l": F.explode(F.sequence(F.lit(0), blocks("out") - 1)), "r": own("all")}).select(*held)
    left = rows.filter("name != main").withColumns({"left": F.lit(True), "l": own("out"), "r": F.explode(F.sequence(F.lit(0), blocks("all") - 1))}).select(*held)
    return stored(left.unionByName(right).groupBy("cluster", "apart", "l", "r").applyInArrow(compare, "a long, b long").distinct(), "pairs")


def block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of a block's left and right documents of different names that sizes and sketches don't rule out."""
    ids, names, n, left = (table.column(c).to_numpy() for c in ("id", "name", "n", "left"))
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    right = np.flatnonzero(~left)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(left):
        may = right[(names[right] != names[k]) & (np.minimum(n[right], n[k]) * DEN >= np.maximum(n[right], n[k]) * NUM)]
        may = may[np.bitwise_count(sketch[may] ^ sketch[k]).sum(1, dtype=np.int64) <= most_different(n[may] + n[k])]
        a.append(np.minimum(ids[may], ids[k]))
        b.append(np.maximum(ids[may], ids[k]))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def block_links(table: pa.Table) -> pa.Table:
    """Links between a block's left and right documents of different names, by counting shared shingles."""
    ids, names, left = (table.column(c).to_pylist() for c in ("id", "name", "left"))
    sets = [exact_set(x) for x in text_bytes(table.column("x").combine_chunks())]
    number: dict[tuple, int] = {}
    right = [k for k in range(len(ids)) if not left[k]]
    holders: list[list[int]] = []
    for place, k in enumerate(right):
        for s in sets[k]:
            at = number.setdefault(s, len(holders))
            if at == len(holders):
                holders.append([])
            holders[at].append(place)
    held = [np.array(h, np.int64) for h in holders]
    size = np.array([len(sets[k]) for k in right], np.int64)
    a, b = [], []
    for k in range(len(ids)):
        shared = [held[number[s]] for s in sets[k] if s in number] if left[k] else []
        if shared:
            both = np.bincount(np.concatenate(shared), minlength=len(right))
            for place in np.flatnonzero((both > 0) & (both * DEN >= NUM * (len(sets[k]) + size - both))):
                if names[right[place]] != names[k]:
                    a.append(min(ids[k], ids[right[place]]))
                    b.append(max(ids[k], ids[right[place]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def apart(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs (a, b) whose names differ."""
    pairs = named(pairs, "a", names).withColumnRenamed("name", "na")
    return named(pairs, "b", names).filter("na != name").select("a", "b")


def several(crowded: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (sig, doc) of crowded groups in several components."""
    rows = named(crowded, "doc", names)
    split = rows.groupBy("sig").agg(F.min("name").alias("least"), F.max("name").alias("most")).filter("least != most").select("sig")
    return stored(crowded.join(beside(stored(split, "split"), F.col("sig")), "sig", "left_semi"), "split")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    rows = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("x"))
    groups = candidate_groups(rows, 1, ROOM)
    names = join_groups(rows, groups)
    out = named(groups.filter(F.col("kind") == IS_META).select("doc", "n"), "doc", names)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
