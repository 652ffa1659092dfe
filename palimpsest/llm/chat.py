"""Chat formatting by columnar byte assembly.

A turn becomes "### role:\\ntext\\n</turn>\\n". Inside roles and texts a backslash stands before
every backslash, "###" and "</turn>" (in roles also before ":"), so taking the escapes away gives
the text back. numpy computes all segments' lengths, cumulative offsets and scatter indices and
copies headers and contents into one preallocated Arrow buffer. The loss mask is a list of byte
ranges: assistants' texts as they stand in the buffer.

Turns are dealt by ranges of (conversation, turn), so a very long conversation is formatted by many
tasks, each giving one row of it for a batch; only digests need its pieces in order, and read them
as a stream.

A batch holds 8 MiB of texts or one text, and its formatted bytes must stay under 2 GiB, as offsets
in an Arrow string column do; a text that is longer than that once escaped can't be formatted.

Null text and null role count as empty. Turns of a null conversation are one conversation. Null
turns come first; repeated turns are ordered by role and text and all kept. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches

LEARNED_ROLE = "assistant"
PIECES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("first_turn", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)),
])
BEFORE, BETWEEN, AFTER = b"### ", b":\n", b"\n</turn>\n"
TURN = re.compile(rb"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
#: Bytes that are copied by one array of scatter indices.
SCATTER_BYTES = 1 << 20


def escaped(column: pa.Array, is_role: bool = False) -> pa.Array:
    for mark in ("\\", "###", "</turn>", *((":",) if is_role else ())):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def unescaped(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.DOTALL) if b"\\" in text else text


def scatter(out: np.ndarray, starts: np.ndarray, column: pa.Array) -> None:
    """Copies each value of column to its place in out."""
    data, offsets = values_of(column)
    lengths = np.diff(offsets)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SCATTER_BYTES, "right")) - 1)
        if b == a + 1:
            out[starts[a]:starts[a] + lengths[a]] = data[offsets[a]:offsets[b]]
        else:
            out[np.repeat(starts[a:b] - offsets[a:b], lengths[a:b]) + np.arange(offsets[a], offsets[b])] = data[offsets[a]:offsets[b]]
        a = b


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer; where each begins (and the end), where its text begins and ends."""
    roles, texts = escaped(roles, True), escaped(texts)
    role_size, text_size = np.diff(values_of(roles)[1]), np.diff(values_of(texts)[1])
    size = role_size + text_size + len(BEFORE) + len(BETWEEN) + len(AFTER)
    offsets = np.concatenate([[0], np.cumsum(size)])
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    role_at = offsets[:-1] + len(BEFORE)
    text_at = role_at + role_size + len(BETWEEN)
    for mark, at in ((BEFORE, offsets[:-1]), (BETWEEN, text_at - len(BETWEEN)), (AFTER, text_at + text_size)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    scatter(out, role_at, roles)
    scatter(out, text_at, texts)
    return buffer, offsets, text_at, text_at + text_size


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED_ROLE) -> DataFrame:
    """Rows of PIECES: conversations in order, long ones in several pieces (first_turn, piece: their order)."""
    small_batches(turns.sparkSession)
    empty = F.lit("")
    rows = turns.select(turns[conv_col].cast("long").alias("c"), turns[turn_col].cast("long").alias("t"), F.coalesce(turns[role_col].cast("string"), empty).alias("r"), F.coalesce(turns[text_col].cast("string"), empty).alias("x"))
    rows = rows.repartitionByRange("c", "t").sortWithinPartitions("c", "t", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn, role, text = batch.columns
            buffer, offsets, start, end = assemble(role, text)
            key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], batch.num_rows)
            learn = np.flatnonzero(pc.equal(role, learned).to_numpy(zero_copy_only=False))
            own = np.cumsum(new)[learn] - 1
            begins = offsets[first]
            ranges = pa.StructArray.from_arrays([pa.array(start[learn] - begins[own], pa.int32()), pa.array(end[learn] - begins[own], pa.int32())], fields=[pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(first) + 1)), pa.int32()), ranges)
            edges = pa.py_buffer(np.append(begins, offsets[-1]).astype(np.int32))
            formatted = pa.StringArray.from_buffers(len(first), edges, buffer)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), turn.take(pa.array(first)), pa.array(piece + np.arange(len(first))), pa.array(ends - first), formatted, loss], names=PIECES.names)
            piece += len(first)

    return rows.mapInArrow(run, PIECES)


def parsed(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a piece."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescaped(m[1]), unescaped(m[2][:-1])
        at = m.end()


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, by reading the formatted bytes."""
    small_batches(pieces.sparkSession)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "piece").select("conv_id", "formatted", "loss")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        for batch in batches:
            done = []
            for conv, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                if not now or now[0] != conv:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(formatted):
                    now[1] += 1
                    now[2].update(role + b"\n" + text + b"\n")
                for r in loss:
                    learned = unescaped(formatted[r["start"]:r["end"]])
                    now[3] += len(learned.decode())
                    now[4].update(learned)
                now[5] += len(formatted.decode())
            yield result(done)
        yield result([now] if now else [])

    def result(done: list) -> pa.RecordBatch:
        columns = [[d[0] for d in done], [d[1] for d in done], [d[2].hexdigest() for d in done], [d[3] for d in done], [d[4].hexdigest() for d in done], [d[5] for d in done]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)

    return ordered.mapInArrow(run, schema)
