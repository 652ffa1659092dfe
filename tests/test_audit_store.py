"""The audit store: repeated batches, updates and purges that leave other folders alone."""

import datetime as dt
import os

from pyspark.sql import functions as F

from palimpsest.operators.audit_store import AuditStore, preferred
from palimpsest.scratch import scratch_path


def events(spark, rows):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    return spark.createDataFrame([(at(d, h), m, n) for d, h, m, n in rows], "time timestamp, method string, redacted_count long")


def files(store):
    root = store.path.removeprefix("file://")
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def rows(store):
    return sorted((r.id, r.time.day, r.method, r.redacted_count) for r in store.read().collect())


def test_a_repeated_batch_is_inserted_once(spark):
    store = AuditStore(spark, scratch_path(spark, "store"))
    assert store.max_id() == 0 and rows(store) == []
    one, two = events(spark, [(1, 1, "GET", 1), (1, 2, "PUT", 2), (3, 1, "GET", 3)]), events(spark, [(3, 5, "GET", 4)])
    assert store.insert(one, "s-0") == 3 and store.insert(two, "s-1") == 4
    before = rows(store)
    assert store.insert(one, "s-0") == 3 and rows(store) == before and store.insert(two, "s-1") == 4 and rows(store) == before
    assert sorted(r[0] for r in before) == [1, 2, 3, 4] and store.insert(events(spark, []), "s-2") == 4
    assert preferred(store, one).count() == 4 and preferred(None, one).count() == 3


def test_a_stream_that_fails_half_way_inserts_each_event_once(spark):
    source, state = scratch_path(spark, "events"), scratch_path(spark, "state")
    made = events(spark, [(1 + k % 5, 1, "GET", k) for k in range(50)])
    made.repartition(4).write.parquet(source)
    store = AuditStore(spark, scratch_path(spark, "store"))
    stream = lambda: spark.readStream.schema(made.schema).parquet(source)
    real, failed = store.insert, []

    def fails_after_writing(batch, name=None):
        real(batch, name)
        if not failed:
            failed.append(name)
            raise RuntimeError("lost")

    store.insert = fails_after_writing
    try:
        store.feed(stream(), state).awaitTermination()
    except Exception:
        pass
    assert failed and store.read().count() == 50
    store.feed(stream(), state).awaitTermination()
    assert store.read().count() == 50 and store.read().select("id").distinct().count() == 50 and store.max_id() == 50


def test_updates_and_purges_touch_only_their_folders(spark):
    store = AuditStore(spark, scratch_path(spark, "store"))
    store.insert(events(spark, [(1, 1, "GET", 1), (2, 1, "GET", 2), (2, 9, "PUT", 3), (3, 1, "GET", 4)]).coalesce(1), "a")
    store.insert(events(spark, [(3, 2, "GET", 5)]), "b")
    first = files(store)
    changed = store.read().filter("redacted_count = 5").withColumn("method", F.lit("DONE"))
    store.update(changed.unionByName(changed.withColumn("id", F.lit(99).cast("long"))))
    assert ("DONE", 5) in {r[2:] for r in rows(store)} and len(rows(store)) == 5
    same = {f for f in first if "day=2024-01-03/batch=b" not in f}
    assert all(files(store)[f] == first[f] for f in same) and len(same) == len(first) - 1
    store.purge(F.lit(dt.datetime(2024, 1, 3, 5)), 86400)  # the limit is five o'clock of the second
    assert [r[3] for r in rows(store)] == [3, 4, 5] and not any("day=2024-01-01" in f for f in files(store))
    assert all(files(store)[f] == first[f] for f in first if "day=2024-01-03/batch=a" in f)
    store.purge(F.lit(dt.datetime(2024, 3, 1)), 86400)
    assert rows(store) == []
    store.clear()
    assert rows(store) == [] and store.insert(events(spark, [(1, 1, "GET", 1)])) == 1
