"""Late rows put into a day-partitioned Parquet layout by deletion vectors.

A layout keeps one row of each id, the latest arrived, in folders by day, each day cut in the order
of (time, id) into files of a fixed number of rows. merge_late() finds where the ids of late rows
stand (day, file, _metadata.row_index) and marks the outgoing positions of each file in bitmaps, the
deletion vectors. Only days that lose or get a row are read again: positions are masked, late rows
are merged in by order, and the day is cut anew. Spark's dynamic partition overwrite puts these days
in place of the old ones when all their files are written; other days' files aren't touched.

Nothing passes through one task but a file, which its task streams in order: rows are ranged over
tasks by (day, time, id), the tasks' counts for each day give every row its place, and rows of one
file meet in the task that writes it. The driver learns the days and their numbers of files.

merge_late() may run again with the same rows, after a failure too: a late row takes the place of
its equal, so the layout comes out the same.

Null times stand in day -1. A null arrival is earlier than any other. A null id is one id. Rows of
one id that arrived together: the largest by the other columns, in their order, stays (nulls are
smallest), and repeated rows are one. Without rows there are no files. Columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import deleted, in_tasks, scratch

DAY_MICROS = 86_400_000_000
NO_DAY = -1
#: A task writes files of so many rows together (one file, if it has more), and so many files at most.
TASK_ROWS, TASK_FILES = 100_000, 32


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970, of times without a zone as they stand."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Layout:
    """Where a layout lies, the columns of its rows, and which of them are id, time (the day's) and arrival."""

    path: str
    schema: T.StructType
    id_col: str
    time_col: str
    arrival_col: str
    rows_per_file: int

    @property
    def names(self) -> list[str]:
        """Names by place that clash with nothing of ours."""
        return [f"c{k}" for k in range(len(self.schema))]

    def name(self, column: str) -> str:
        return self.names[self.schema.names.index(column)]

    @property
    def folder(self) -> str:
        """The partition column: day, with underscores if rows have a column of that name."""
        name, taken = "day", {c.lower() for c in self.schema.names}
        while name in taken:
            name += "_"
        return name

    def day(self) -> Column:
        days = F.floor(micros(F.col(self.name(self.time_col)), self.schema[self.time_col].dataType) / F.lit(DAY_MICROS)).cast("long")
        return F.coalesce(days, F.lit(NO_DAY).cast("long"))

    def version(self, prefix: str = "") -> Column:
        """Greater for the row that stays of one id."""
        first = self.name(self.arrival_col)
        return F.struct(*[F.col(prefix + c).alias(c) for c in [first, *[c for c in self.names if c != first]]])

    def latest(self, rows: DataFrame) -> DataFrame:
        """The row of each id that stays; gathered before the shuffle, so an id's copies never meet."""
        rows = rows.select(*[rows[c] for c in self.schema.names]).toDF(*self.names)
        best = rows.groupBy(F.col(self.name(self.id_col)).alias("id")).agg(F.max(self.version()).alias("best"))
        return best.select(*[F.col("best")[c].alias(c) for c in self.names])

    def standing(self, spark: SparkSession) -> DataFrame:
        """The layout's rows with day, part (the file's number in its day's write) and row_index."""
        stored = T.StructType([*self.schema.fields, T.StructField(self.folder, T.LongType())])
        rows = spark.read.schema(stored).parquet(self.path)
        return rows.select(*[rows[c].alias(n) for c, n in zip(self.schema.names, self.names)], rows[self.folder].alias("day"), file_order().alias("part"), F.col("_metadata.row_index").alias("row_index"))


def file_order() -> Column:
    """A number by which the files of a day are ordered: that of the task, then that of the file in its task."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return number(r"^part-(\d+)") * TASK_FILES + number(r"\.c(\d+)")


def write_days(rows: DataFrame, layout: Layout, keep, mode: str) -> list[int]:
    """rows (with day) as the files of their days; the days that have rows."""
    order = ["day", layout.name(layout.time_col), layout.name(layout.id_col)]
    ranged = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order), "ranged")
    ranged = ranged.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("range"), F.col("_metadata.row_index").alias("row_index"))
    # ranges are in order, so there is about one row for each range and one for each day
    counts = keep(ranged.groupBy("range", "day").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first")), "counts")
    each = F.lit(layout.rows_per_file)
    files = {r.day: r.files for r in counts.groupBy("day").agg(F.ceil(F.sum("n") / each).alias("files")).collect()}
    if not files and mode == "overwrite":
        return []
    days = counts.groupBy("day").agg(F.ceil(F.sum("n") / each).alias("files"))
    days = days.select("day", F.coalesce(F.sum("files").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_file"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("day").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("before", before).join(days, "day").select(F.col("range").alias("r"), F.col("day").alias("d"), "first", "before", "first_file")
    placed = ranged.join(F.broadcast(places), (F.col("range") == F.col("r")) & (F.col("day") == F.col("d")))
    file_id = F.col("first_file") + F.floor((F.col("before") + F.col("row_index") - F.col("first")) / each)
    # a task begins where a file does and gets whole files, which the writer cuts by the number of rows
    together = max(1, min(TASK_FILES, TASK_ROWS // layout.rows_per_file))
    tasks = max(1, -(-sum(files.values()) // together))
    whole = placed.withColumn("task", F.floor(file_id / together).cast("int")).repartitionById(tasks, F.col("task")).sortWithinPartitions(*order)
    named = whole.select(*[F.col(n).alias(c) for n, c in zip(layout.names, layout.schema.names)], F.col("day").alias(layout.folder))
    named.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", layout.rows_per_file).partitionBy(layout.folder).parquet(layout.path)
    return list(files)


def write_layout(rows: DataFrame, layout: Layout) -> None:
    """A new layout of rows."""
    with scratch() as keep:
        write_days(layout.latest(rows).withColumn("day", layout.day()), layout, keep, "errorifexists")


def deletion_vectors(places: DataFrame) -> DataFrame:
    """day, part, bucket and a bitmap of the outgoing rows in each 32,768 rows of a file."""
    at = F.col("row_index") + 1
    return places.groupBy("day", "part", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("gone"))


def masked(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows (with day, part, row_index) without those that a deletion vector marks."""
    at, v = F.col("row_index") + 1, vectors.toDF("v_day", "v_part", "v_bucket", "gone")
    met = rows.join(v, (F.col("day") == F.col("v_day")) & (F.col("part") == F.col("v_part")) & (F.bitmap_bucket_number(at) == F.col("v_bucket")), "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.expr("substring(gone, CAST(bitmap_bit_position(row_index + 1) DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    return met.filter(F.col("gone").isNull() | (F.getbit(byte, (bit % 8).cast("int")) == 0)).select(*rows.columns)


def merge_late(late: DataFrame, layout: Layout) -> list[int]:
    """Makes the layout that of its rows and the late ones; the days that were written anew."""
    spark, id_ = late.sparkSession, layout.name(layout.id_col)
    with scratch() as keep:
        best = layout.latest(late)
        standing = layout.standing(spark)
        there = standing.select(*[F.col(c).alias(f"s_{c}") for c in layout.names], "day", "part", "row_index")
        # joined by id as late rows are already dealt out; of one id there is one late row
        met = best.join(there, F.col(id_).eqNullSafe(F.col(f"s_{id_}")), "left")
        place = F.struct("day", "part", "row_index", (layout.version("s_") <= layout.version()).alias("out"))
        met = met.groupBy(F.col(id_).alias("id")).agg(F.any_value(F.struct(*layout.names)).alias("late"), F.collect_list(F.when(F.col("row_index").isNotNull(), place)).alias("places"))
        met = keep(met, "met")
        inserts = met.filter(F.forall("places", lambda p: p["out"])).select("late.*").withColumn("day", layout.day())
        outgoing = met.select(F.explode("places").alias("p")).filter("p.out").select("p.day", "p.part", "p.row_index")
        # one for each calendar day at most
        days = sorted(r.day for r in inserts.select("day").union(outgoing.select("day")).distinct().collect())
        if not days:
            return []
        old = masked(standing.filter(F.col("day").isin(days)), keep(deletion_vectors(outgoing), "vectors"))
        left = write_days(old.select(*layout.names, "day").unionByName(inserts), layout, keep, "overwrite")
        # a day that has lost all its rows isn't written, so nothing takes its place
        deleted(spark, *[f"{layout.path}/{layout.folder}={d}" for d in days if d not in left])
    return days


def layout_files(spark: SparkSession, layout: Layout) -> DataFrame:
    """day, part, file_no (from 0 in each day), path and n_rows of each data file."""
    rows = spark.read.schema(T.StructType([*layout.schema.fields, T.StructField(layout.folder, T.LongType())])).parquet(layout.path)
    path = F.regexp_replace("_metadata.file_path", r"^file:/(?!/)", "file:///")
    files = rows.groupBy(rows[layout.folder].alias("day"), file_order().alias("part"), path.alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    return files.withColumn("file_no", (F.row_number().over(W.partitionBy("day").orderBy("part")) - 1).cast("long"))


def layout_columns(spark: SparkSession, layout: Layout) -> list[str]:
    """The columns that the files hold, from all their footers."""
    return [c for c in spark.read.option("mergeSchema", "true").parquet(layout.path).columns if c != layout.folder]


def file_digests(rows: DataFrame) -> DataFrame:
    """day, part, n_rows, cents, rows_crc and ids_sha256 of files, from rows of day, part, row_index, id, cents and crc: each file streamed in its order."""
    schema = T.StructType([T.StructField("day", T.LongType()), T.StructField("part", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_rows", "cents", "rows_crc")], T.StructField("ids_sha256", T.StringType())])
    ordered = rows.select("day", "part", "row_index", "id", "cents", "crc").repartition("day", "part").sortWithinPartitions("day", "part", "row_index")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            made = [[*key, n, cents, crc, sha.hexdigest()] for key, n, cents, crc, sha in done]
            done.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, m)) for m in made], schema=ARROW_DIGEST)

        for batch in batches:
            if not batch.num_rows:
                continue
            day, part = (batch.column(k).to_numpy() for k in (0, 1))
            cents, crc = (batch.column(k).to_numpy() for k in (4, 5))
            ids = batch.column(3).cast(pa.string()).fill_null("").to_pylist()
            starts = np.append(0, np.flatnonzero((np.diff(day) != 0) | (np.diff(part) != 0)) + 1).tolist()
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                key = (int(day[a]), int(part[a]))
                if now is None or now[0] != key:
                    if now is not None:
                        done.append(now)
                    now = [key, 0, 0, 0, hashlib.sha256()]
                now[4].update((("," if now[1] else "") + ",".join(ids[a:b])).encode())
                now[1] += b - a
                now[2] += int(cents[a:b].sum())
                now[3] += int(crc[a:b].sum())
            if done:
                yield out()
        if now is not None:
            done.append(now)
            yield out()

    return ordered.mapInArrow(in_tasks(digest), schema)


ARROW_DIGEST = pa.schema([("day", pa.int64()), ("part", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])
