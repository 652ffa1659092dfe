"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on document ids.

write_tokens() sorts documents by id across files and encodes them on the way out, so each part
file is an ascending range of ids. Readers split files by stripe; a filter on doc_id prunes files'
stripes by their statistics and row groups by row index and Bloom filter.

Null text counts as empty: its only id is the end id. Null doc_ids come first. Rows that share a
doc_id are all kept, ordered by text. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import in_tasks, small_batches

END_ID = 0
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
#: Bytes of text that are encoded at once; longer texts are cut at blanks.
CHUNK_BYTES = 3 << 20
#: Bytes of a batch between the JVM and Python, beside which the writer holds stripes.
BATCH_BYTES = 4 << 20
#: Words whose ids are remembered, at most, but for those of one chunk; and their bytes on average.
REMEMBERED = 600_000
REMEMBERED_BYTES = 100
#: Pieces that the library gets as one text.
JOINED = 200
#: Marks that end a word: a byte-level pre-tokenizer parts them from letters and digits before them.
MARKS = ",.;:!?"
#: Texts whose white space isn't single blanks and line feeds between words.
IRREGULAR = r"  |\n\n| \n|\n |\x00|\A[ \n]|[ \n]\z|[\t\v\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def words_and_marks(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words: pieces without the marks behind their last letter or digit; each piece's place among them; and its marks as bytes of a number, 0 without any or with more than 8."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1:pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"\0", np.uint8)
    marked = np.isin(data[np.maximum(ends, 1) - 1], np.frombuffer(MARKS.encode(), np.uint8)) & (pc.binary_length(pieces).to_numpy() > 0)
    some = pieces.filter(pa.array(marked))
    words = pc.utf8_rtrim(some, MARKS)
    n = (pc.binary_length(some).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
    n[(n > 8) | ~pc.match_substring_regex(words, r"[\p{L}\p{N}]\z").to_numpy(zero_copy_only=False)] = 0
    code, own = np.zeros(len(some), np.uint64), ends[marked]
    for i in range(8):
        more = n > i
        code[more] = code[more] << np.uint64(8) | data[own[more] - n[more] + i]
    marks, place = np.zeros(len(pieces), np.uint64), np.empty(len(pieces), np.int64)
    marks[marked] = code
    place[marked], place[~marked] = np.arange(len(some)) + len(pieces) - len(some), np.arange(len(pieces) - len(some))
    return pa.concat_arrays([pieces.filter(pa.array(~marked)), pc.if_else(pa.array(n > 0), words, some)]), place, marks


@dataclass(frozen=True)
class Described:
    """A tokenizer's file and what encoders need to know of it: read once by the driver, as a vocabulary in Python objects takes many times the memory of the library's own."""

    tokenizer_json: str
    by_piece: bool
    irregular: str
    bytes_of: np.ndarray = field(compare=False)


def described(tokenizer_json: str) -> Described:
    from tokenizers import Tokenizer

    parts = json.loads(tokenizer_json)
    before, model = parts.get("pre_tokenizer") or {}, parts["model"]
    by_piece = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
                and not any(parts.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
    special = "|".join(re.escape(t["content"]) for t in parts.get("added_tokens") or [])
    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True)
    bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():  # byte-level BPE shows each byte as a character
        bytes_of[i] = len(token)
    return Described(tokenizer_json, by_piece, f"{IRREGULAR}|{special}" if special else IRREGULAR, bytes_of)


class PieceEncoder:
    """Encodes whole texts with a tokenizer of the tokenizers library, which gives every id.

    A byte-level pre-tokenizer never joins what a blank and a character part. So a text whose white
    space is single blanks and line feeds between words is sent to the library as its different pieces
    (a word with the blank or line feed before it), those of many texts together and each once; ids are
    told apart by the bytes they stand for, and those of about `remembered` pieces are kept. Any other
    text goes to the library as it is, and all texts do if the tokenizer is of another kind.
    """

    def __init__(self, tokenizer_json: str | Described, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        about = tokenizer_json if isinstance(tokenizer_json, Described) else described(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(about.tokenizer_json)
        self.by_piece, self.irregular, self.bytes_of = about.by_piece, about.irregular, about.bytes_of
        self.forget()

    def forget(self) -> None:
        """Words that are known, where their ids begin in `ids` and how many they are; the empty one has none."""
        self.known, self.ids = pa.array([""]), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, words: pa.Array, ids: list[np.ndarray], count: np.ndarray) -> None:
        ids = np.concatenate(ids)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.known, self.ids, self.count = pa.concat_arrays([self.known, words]), np.concatenate([self.ids, ids]), np.concatenate([self.count, count])

    def pieces(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and each one's number of ids. A piece is "\0" and a text's first word, a word that follows a blank, or "\n" and a word; an empty one has no ids."""
        if len(self.known) > self.remembered or self.known.nbytes > REMEMBERED_BYTES * self.remembered:
            self.forget()
        words, place, marks = words_and_marks(coded.dictionary)
        found = pc.index_in(words, value_set=self.known)
        at = found.fill_null(-1).to_numpy().copy()
        if found.null_count:
            new = words.filter(found.is_null()).dictionary_encode()
            at[at < 0] = self.learn(new.dictionary)[new.indices.to_numpy()]
        kinds, mark = np.unique(marks, return_inverse=True)
        tails = self.whole([int(k).to_bytes(8, "big").lstrip(b"\0").decode() for k in kinds])
        ids, sizes = np.concatenate([self.ids, *tails]), np.array([len(x) for x in tails])
        # each piece's ids: those of its word, then those of its marks
        index = coded.indices.to_numpy()
        start = np.stack([self.start[at[place]], (len(self.ids) + np.cumsum(sizes) - sizes)[mark]], 1)[index]
        count = np.stack([self.count[at[place]], sizes[mark]], 1)[index]
        return ids[take(start.ravel(), count.ravel())], count.sum(1)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Has the library encode words that aren't known; their places in `known`."""
        first = pc.starts_with(words, "\0")
        alone, after = first.to_numpy(zero_copy_only=False), np.empty(len(words), np.int64)
        after[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = len(self.known) + np.arange(len(words))
        alone, words = words.filter(first), words.filter(pc.invert(first))
        if len(alone):
            ids = self.whole([w[1:] for w in alone.to_pylist()])
            self.remember(alone, ids, np.array([len(x) for x in ids]))
        if len(words):
            spelt = pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
            joined = pa.ListArray.from_arrays(pa.array([*range(0, len(spelt), JOINED), len(spelt)], pa.int32()), spelt)
            ids, stops = np.concatenate(self.whole(pc.binary_join(joined, "").to_pylist())), np.cumsum(pc.binary_length(spelt).to_numpy(), dtype=np.int64)
            ends = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(ends, stops)
            if last[-1] >= len(ends) or (ends[last] != stops).any():
                raise ValueError("the tokenizer joins pieces over blanks")
            self.remember(words, [ids], np.diff(last, prepend=-1))
        return after

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size, parts, counts = pc.binary_length(texts).to_numpy(zero_copy_only=False), [], []
        a, n, most = 0, len(texts), CHUNK_BYTES if self.remembered >= REMEMBERED else CHUNK_BYTES * 2 // 3  # who remembers less is short of memory
        while a < n:
            b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), most, "right")) + a)
            ids, count = self.chunk(texts.slice(a, b - a))
            parts.append(ids)
            counts.append(count)
            a = b
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([np.zeros(0, np.int64), *counts])

    def chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        irregular = pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        if len(texts) == 1 and len(texts[0].as_buffer()) > 2 * CHUNK_BYTES and not irregular[0]:
            made = self.in_parts(texts[0].as_py())
            if made is not None:
                return made, np.array([len(made)])
            irregular = ~irregular
        pieces, owner = self.split(texts, irregular)
        ids, each = self.pieces(pieces.dictionary_encode())
        total = np.bincount(owner, each, len(texts)).astype(np.int64)
        if not irregular.any():
            return ids, total
        own = self.whole([texts[int(k)].as_py() for k in np.flatnonzero(irregular)])
        total[irregular] = list(map(len, own))
        out, mine = np.empty(int(total.sum()), np.int32), np.repeat(irregular, total)
        out[mine], out[~mine] = np.concatenate(own), ids
        return out, total

    def split(self, texts: pa.Array, irregular: np.ndarray, first: str = "\0") -> tuple[pa.Array, np.ndarray]:
        """Pieces and their texts' numbers; irregular texts have an empty piece."""
        plain = pc.if_else(pa.array(irregular), "", texts)
        plain = pc.replace_substring(plain, "\n", " \n").cast(pa.string())
        lists = pc.split_pattern(pc.binary_join_element_wise(first, plain, ""), " ")
        return lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())

    def in_parts(self, text: str) -> np.ndarray | None:
        """Ids of a long regular text, cut before blanks; None if there is no place to cut."""
        out, a, step = [], 0, CHUNK_BYTES // 4
        while a < len(text):
            b = text.rfind(" ", a + 1, a + step) if a + step < len(text) else len(text)
            if b < 0:
                return None
            pieces, _ = self.split(pa.array([text[a:b]], pa.large_string()), np.zeros(1, bool), "" if a else "\0")
            out.append(self.pieces(pieces.dictionary_encode())[0])
            a = b
        return np.concatenate(out)


@lru_cache(maxsize=1)
def encoder(about: Described, remembered: int) -> PieceEncoder:
    return PieceEncoder(about, remembered)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, end_id: int = END_ID, remembered: int = REMEMBERED) -> None:
    """Writes doc_id, local_start (ids before it in its file), n_tokens and ids, files and rows in ascending doc_id order. A task's worker remembers so many pieces' ids, at some 200 bytes each."""
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's file; executors get its contents
        model = docs.sparkSession.sparkContext.broadcast(described(f.read()))
    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(model.value, remembered), 0
        for batch in batches:
            ids, count = enc.encode(batch.column(1))
            ends = np.cumsum(count + 1)
            out, own = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32), np.ones(len(ids) + len(count), bool)
            own[ends - 1] = False
            out[own] = ids
            starts = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + starts[:-1]), pa.array(count + 1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out))], names=SCHEMA.names)
            before += int(starts[-1])

    (ordered.mapInArrow(in_tasks(encode), SCHEMA).write.option("orc.stripe.size", str(stripe_bytes)).option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """part (the file's number), doc_id, local_start, n_tokens, ids; with doc_ids, stripes and row groups without them are skipped."""
    table = spark.read.schema(SCHEMA).orc(path)
    if doc_ids is not None:
        table = table.filter(table.doc_id.isin(list(doc_ids)))
    return table.select(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("part"), *SCHEMA.names)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    small_batches(spark, size=BATCH_BYTES)
    table = read_tokens(spark, path)
    schema = T.StructType([T.StructField("part", T.IntegerType()), *SCHEMA.fields[:3], T.StructField("ids_crc32", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    # one row for each file: a running sum in one task stays small
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    digests = table.select("part", "doc_id", "local_start", "ids").mapInArrow(in_tasks(digest), schema)
    return digests.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
