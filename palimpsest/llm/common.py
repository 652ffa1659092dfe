"""Shared plumbing: scratch tables, Arrow batches, words and text columns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Bytes an Arrow batch of texts may hold, so that a task's memory doesn't follow the rows' lengths.
BATCH_BYTES = 8 << 20
#: ASCII upper case to lower case; every other ASCII byte that is no digit or letter to a space.
PLAIN_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own, which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder[app] = f"file://{folder}"
    return _own_folder[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written once to the shared folder and read from there: what follows survives lost executors and isn't computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def deleted(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared folder that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """stored() for tables that go when the block ends; what leaves the block must be stored by itself."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        made.append(stored(df, name, partition_by))
        return made[-1]

    try:
        yield keep
    finally:
        for df in made:
            deleted(df.sparkSession, df.stored_at)


def small_batches(spark: SparkSession, rows: int = 4000, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


class LongTable:
    """Distinct keys (int64, not negative) to their places, by open addressing; looks up arrays of keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, todo = self.slots(keys), np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            self.places[at[free]] = todo[free]  # of several for one slot the last stays
            won = free[self.places[at[free]] == todo[free]]
            self.keys[at[won]] = keys[todo[won]]
            at, todo = np.delete(at, won), np.delete(todo, won)
            at = at + 1 & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        at = self.slots(keys)
        held = self.keys[at]
        same = held == keys
        found = np.where(same, self.places[at], np.int32(-1))
        open_ = np.flatnonzero(~same & (held >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            same = held == keys[open_]
            found[open_[same]] = self.places[at[same]]
            more = ~same & (held >= 0)
            open_, at = open_[more], at[more]
        return found


def in_tasks(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow(): at a task's end, memory that is free goes back to the system, as Python workers outlive tasks and stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def append_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[list[bytes | None]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs, then `fields` as compute() makes them from a batch of texts.

    An input column with the name of a new one gives way to it. The text travels once: as the kept
    column, if it is a kept string.
    """
    small_batches(docs.sparkSession)
    new = [f.name for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType):
        at, source = kept.index(text_col), docs.select(*[docs[c] for c in kept])
    else:
        inner = "text_in_hand"
        while inner in kept:
            inner += "_"
        at, source = len(kept), docs.select(*[docs[c] for c in kept], docs[text_col].cast("string").alias(inner))
    schema = T.StructType([source.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(text_bytes(batch.column(at)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=kept + new)

    return source.mapInArrow(in_tasks(run), schema)
