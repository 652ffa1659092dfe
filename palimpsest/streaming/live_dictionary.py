"""A session's dictionary kept while hits stream in: first registrations, numbered placeholders, capacity and time to live.

State is one session's, in RocksDB: a map of originals, one of placeholders (which finds equal
placeholders of different originals), one of registrations by their number, and the numbers of the
oldest and the next. So a registration, an eviction and an expiry each touch a few keys, whatever a
session holds. A timer at the oldest registration's end takes out what has lived too long.

Within a batch hits are taken in the order (doc_ord, start descending), which is that of the batch
dictionary; batches come in the order of their files. Times are the hits' own, so results don't
depend on when a batch runs.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.dictionary import DIGITS, PREFIX

EVENTS = "session_id string, event string, original string, category string, placeholder string, created_at long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Dictionary(StatefulProcessor):
    """Events (registered, evicted, expired) of sessions, from hits (session_id, doc_ord, start, category, original, at)."""

    def __init__(self, key: bytes, most: int, ttl_seconds: int | None, prefix: str):
        self.key, self.most, self.ttl, self.prefix = key, most, ttl_seconds, prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.by_original = handle.getMapState("by_original", "original string", "number long")
        self.by_placeholder = handle.getMapState("by_placeholder", "placeholder string", "number long")
        self.by_number = handle.getMapState("by_number", "number long", "original string, category string, placeholder string, created_at long")
        self.ends = handle.getValueState("ends", "oldest long, next long")

    def placeholder(self, category: str, original: str) -> str:
        base = f"{self.prefix}{category}_{hmac.new(self.key, original.encode(), hashlib.sha256).hexdigest()[:DIGITS]}"
        name, n = f"{base}__", 1
        while self.by_placeholder.containsKey((name,)):
            n += 1
            name = f"{base}_{n}__"
        return name

    def leave(self, number: int) -> tuple:
        """The oldest registration goes."""
        original, category, placeholder, created_at = self.by_number.getValue((number,))
        self.by_number.removeKey((number,))
        self.by_original.removeKey((original,))
        self.by_placeholder.removeKey((placeholder,))
        return original, category, placeholder, created_at

    def expire(self, oldest: int, next_: int, now: int, out: list, session: str) -> int:
        while self.ttl is not None and oldest < next_ and now - self.by_number.getValue((oldest,))[3] > self.ttl:
            out.append((session, "expired", *self.leave(oldest)))
            oldest += 1
        return oldest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, out = key[0], []
        oldest, next_ = self.ends.get() if self.ends.exists() else (0, 0)
        was_oldest = oldest if oldest < next_ else None
        hits = pd.concat(list(rows)).sort_values(["doc_ord", "start"], ascending=[True, False], kind="stable")
        for r in hits.itertuples():
            at = int(r.at)
            oldest = self.expire(oldest, next_, at, out, session)
            if self.by_original.containsKey((r.original,)):
                continue
            while next_ - oldest >= self.most:
                out.append((session, "evicted", *self.leave(oldest)))
                oldest += 1
            name = self.placeholder(r.category, r.original)
            self.by_original.updateValue((r.original,), (next_,))
            self.by_placeholder.updateValue((name,), (next_,))
            self.by_number.updateValue((next_,), (r.original, r.category, name, at))
            out.append((session, "registered", r.original, r.category, name, at))
            next_ += 1
        self.ends.update((oldest, next_))
        if self.ttl is not None and oldest < next_ and was_oldest != oldest:
            self.handle.registerTimer(self.end_of(oldest))
        yield frame(out)

    def end_of(self, number: int) -> int:
        return (self.by_number.getValue((number,))[3] + self.ttl + 1) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, (oldest, next_) = [], self.ends.get()
        oldest = self.expire(oldest, next_, timerValues.getCurrentWatermarkInMs() // 1000, out, key[0])
        self.ends.update((oldest, next_))
        if oldest < next_:
            self.handle.registerTimer(self.end_of(oldest))
        yield frame(out)

    def close(self) -> None:
        pass


def frame(events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(events, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"created_at": "int64"})


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for queries that start here; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dictionary_stream(hits: DataFrame, key: bytes, most: int = 100_000, ttl_seconds: int | None = None, prefix: str = PREFIX) -> DataFrame:
    """EVENTS of a stream of hits (session_id, doc_ord, start, category, original, at in seconds); start the query within rocksdb()."""
    if ttl_seconds is not None:
        hits = hits.selectExpr("*", "timestamp_seconds(at) AS time_").withWatermark("time_", "0 seconds")
    mode = "EventTime" if ttl_seconds is not None else "None"
    return hits.groupBy("session_id").transformWithStateInPandas(Dictionary(key, most, ttl_seconds, prefix), StructType.fromDDL(EVENTS), "Append", mode)


def standing(events: DataFrame) -> DataFrame:
    """(session_id, original, category, placeholder, created_at) that sessions hold after all events: registrations that haven't left."""
    gone = events.filter("event != 'registered'").select("session_id", "placeholder", "created_at", "original")
    return events.filter("event = 'registered'").drop("event").join(gone, ["session_id", "placeholder", "created_at", "original"], "left_anti")
