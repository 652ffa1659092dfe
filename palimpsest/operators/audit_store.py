"""Audit events in Parquet, in folders by day and by batch.

A batch of events is written by dynamic partition overwrite under its own name, so writing it again
(as a stream does that failed half way) puts the same events in the same place. Updates write only
the folders that hold an event they change; a purge drops whole days without reading them, and writes
the day in which the limit falls anew. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..scratch import stored
from . import audit

MATCHES = "array<struct<category:string,placeholder:string,value:string,is_preview:boolean,length:int,truncated:boolean>>"
#: The fifteen columns of an event.
EVENTS = f"""id long, time timestamp, host string, method string, path string, content_type string, content_encoding string, attempted boolean, redacted_count long, matches {MATCHES},
  note string, response_status int, response_content_type string, restore_applied boolean, restored_count long"""
#: Bits of an event's number in its task.
TASK_BITS = 33


class AuditStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.events = spark, path.rstrip("/"), T.StructType.fromDDL(EVENTS)
        self.stored = T.StructType([*self.events.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rows(self) -> DataFrame:
        place, files = self._files()
        if not files.exists(place):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        """rows (with day and batch) in place of their folders' contents."""
        rows.select(*self.stored.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def _drop(self, *folders: str) -> None:
        _, files = self._files()
        for f in folders:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}{f}"), True)

    def _shaped(self, events: DataFrame) -> DataFrame:
        given = set(events.columns)
        return events.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.events.fields], F.to_date("time").alias("day"))

    def read(self) -> DataFrame:
        return self._rows().select(*self.events.names)

    def max_id(self) -> int:
        return audit.next_id(self._rows()).first()[0]

    def insert(self, events: DataFrame, batch: str | None = None) -> int:
        """Adds events; each gets the next id. Returns the largest. A batch of the same name takes the place of the one that is there, with the same ids.

        Events are counted by task, and only these counts meet, so no task numbers them all.
        """
        batch = batch or uuid.uuid4().hex
        rows = stored(events.withColumn("place_", F.monotonically_increasing_id()), "events")
        task, own = F.shiftright("place_", TASK_BITS), F.col("place_").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
        counts = {r.t: r.n for r in rows.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
        there = self._rows()
        again = there.filter(F.col("batch") == batch).agg(F.min("id")).first()[0]
        at, first = (again - 1) if again is not None else self.max_id(), {}
        for t in sorted(counts):
            first[t], at = at, at + counts[t]
        if not counts:
            return at
        starts = self.spark.createDataFrame(list(first.items()), "task_ long, first_ long")
        numbered = rows.join(F.broadcast(starts), task == F.col("task_")).withColumn("id", F.col("first_") + own + 1)  # a row for each task
        self._write(self._shaped(numbered).withColumn("batch", F.lit(batch)))
        return at

    def update(self, events: DataFrame) -> None:
        """Events by id as they are now; they keep the day and batch in which they came. Unknown ids are left out."""
        new = stored(self._shaped(events).drop("day"), "updates")
        held = self._rows()
        places = stored(held.join(new.select("id"), "id", "left_semi").select("day", "batch").distinct(), "places")
        days = [r.day for r in places.select("day").distinct().collect()]
        touched = held.filter(F.col("day").isin(days)).join(places, ["day", "batch"], "left_semi") if days else held.limit(0)
        rest = touched.join(new.select("id"), "id", "left_anti")
        changed = touched.select("id", "day", "batch").join(new, "id")
        if days:
            self._write(stored(rest.select(*self.stored.names).unionByName(changed.select(*self.stored.names)), "merged"))

    def purge(self, now: Column, retention_seconds: int) -> None:
        """Drops what is older than the retention. Whole days go by their folders; no other row is read but those of the day of the limit."""
        limit = self.spark.range(1).select((now - F.make_dt_interval(secs=F.lit(retention_seconds))).alias("t")).select("t", F.to_date("t").cast("string").alias("day")).first()
        place, files = self._files()
        days = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        self._drop(*[f"/{d}" for d in days if d.startswith("day=") and d[4:] < limit.day])  # dates in ISO form: their order is that of text
        edge = self._rows().filter(F.col("day") == F.lit(limit.day).cast("date"))
        batches = [r.batch for r in edge.filter(F.col("time") < F.lit(limit.t)).select("batch").distinct().collect()]
        if batches:
            kept = stored(edge.filter(F.col("batch").isin(batches) & (F.col("time") >= F.lit(limit.t))), "kept")
            left = {r.batch for r in kept.select("batch").distinct().collect()}
            self._write(kept)
            self._drop(*[f"/day={limit.day}/batch={b}" for b in batches if b not in left])

    def clear(self) -> None:
        self._drop("")

    def follow(self) -> DataFrame:
        """A stream of rows as they are written: what the store holds now, then what comes."""
        return self.spark.readStream.schema(self.stored).parquet(self.path).select(*self.events.names)

    def feed(self, events: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """A query that inserts a stream's events, all that are there now; name tells streams of one store apart. A batch that is repeated is inserted once."""
        return events.writeStream.foreachBatch(lambda batch, n: self.insert(batch, f"{name}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def preferred(store: AuditStore | None, ring: DataFrame) -> DataFrame:
    """Where listings read: the store if there is one, else the ring."""
    return store.read() if store is not None else ring
