"""Restoring placeholders in streams of fragments, where a placeholder may be cut anywhere.

What the end of the fragments so far may still become a placeholder (a run of its characters that
holds the prefix, or an end that may become one) is held back, up to LONGEST_TAIL characters; all
before it goes out. So the output doesn't depend on where fragments are cut.
"""

from __future__ import annotations

import heapq
import re
import string
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.dictionary import PREFIX
from ..operators.python_columns import BATCH_ROWS, small_batches
from ..operators.restore import BODY
from .pages import Pages

LONGEST_TAIL = 512
#: A session's capacity.
MOST_MAPPINGS = 100_000
#: Groups that sessions are dealt into by restore_sessions(); the state is laid out by them.
BUCKETS = 4096
#: Mappings and fragments of sessions in one stream.
ROWS = pa.schema([("session_id", pa.string()), ("is_mapping", pa.bool_()), ("name", pa.string()), ("seq", pa.int64()), ("text", pa.string()), ("is_last", pa.bool_())])
RUN = string.ascii_letters + string.digits + "_"


class Restorer:
    def __init__(self, mapping: Mapping[str, str], prefix: str = PREFIX):
        self.mapping, self.prefix, self.bare = mapping, prefix, prefix.lstrip("_") or prefix
        self.lead = prefix[: len(prefix) - len(prefix.lstrip("_"))]
        self.token = re.compile(rf"{re.escape(prefix)}{BODY}|(?<!_){re.escape(self.bare)}{BODY}")
        self.either = re.compile(f"({self.token.pattern})")

    def restore(self, text: str, before: str = "") -> str:
        """text with known placeholders replaced; `before` is the character that stood before it."""

        return self.token.sub(lambda m: self.mapping.get(self.name(m[0]), m[0]), before + text)[len(before):] if text else ""

    def name(self, token: str) -> str:
        """A token in full, as mappings have it."""
        token = token if token.startswith(self.prefix) else self.lead + token
        return token if token.endswith("__") else token + "__"

    def parts(self, text: str, before: str = "") -> list[str]:
        """before + text in pieces: what is no token and tokens by turns."""
        return self.either.split(before + text)

    def cut(self, text: str) -> int:
        """Where what may still become a placeholder begins."""
        run = len(text.rstrip(RUN))
        if self.bare in text[run:]:
            return run if len(text) - run <= LONGEST_TAIL else len(text)
        for k in range(min(len(self.prefix) - 1, len(text) - run), 0, -1):
            if self.prefix.startswith(text[-k:]) or self.bare.startswith(text[-k:]):
                return len(text) - k
        return len(text)

    def feed(self, before: str, tail: str, fragment: str) -> tuple[str, str, str]:
        """Output, the last character that went out, and the tail held back."""
        text = tail + fragment
        at = self.cut(text)
        return self.restore(text[:at], before), text[at - 1:at] or before, text[at:]


def fragments_in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq")


def restore_stream(chunks: DataFrame, mapping: Mapping[str, str], prefix: str = PREFIX) -> DataFrame:
    """(stream_id, seq, output) from a stream of (stream_id, seq, fragment, is_last); state: the tail and the character before it, until the last fragment.

    The mapping is one session's and goes to the tasks with the function, so it may have MOST_MAPPINGS entries at most.
    """
    if len(mapping) > MOST_MAPPINGS:
        raise ValueError(f"a session holds {MOST_MAPPINGS} mappings at most")
    restorer = Restorer(dict(mapping), prefix)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, tail = state.get if state.exists else ("", "")
        rows, over = [], False
        for r in fragments_in_order(frames).itertuples():
            out, before, tail = restorer.feed(before, tail, r.fragment or "")
            if r.is_last:
                out, before, tail, over = out + restorer.restore(tail, before), "", "", True
            rows.append((key[0], r.seq, out))
        if not over:
            state.update((before, tail))
        elif state.exists:  # a stream that has ended leaves nothing behind
            state.remove()
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "output"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, output string", "before string, tail string", "append", GroupStateTimeout.NoTimeout)


class SessionRestorer(StatefulProcessor):
    """Placeholders of a group's sessions, one or more, in pages of a map state, and what each of their streams has held back in others."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known, self.held = Pages(handle, "known"), Pages(handle, "held")

    def columns(self, frame: pd.DataFrame) -> Iterator[list[list]]:
        """The columns of ROWS, a batch at a time."""
        yield [frame[c].tolist() for c in ROWS.names]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, fragments = {}, defaultdict(list)
        for frame in rows:
            for columns in self.columns(frame):
                for session, is_mapping, name, seq, text, is_last in zip(*columns):
                    if is_mapping:
                        new[owned(session, name)] = text
                    else:
                        fragments[session, name].append((seq, text or "", is_last))
        self.known.change(new)
        restorer, made, open_, over = Restorer({}, self.prefix), [], {}, set()
        held = self.held.look_up([owned(*stream) for stream in fragments])
        for stream, own in fragments.items():
            name = owned(*stream)
            before, tail = held.get(name, ("", ""))
            for seq, fragment, is_last in sorted(own, key=itemgetter(0)):
                text = tail + fragment
                at = restorer.cut(text)
                out = [(before, restorer.parts(text[:at], before))]
                before, tail = text[at - 1:at] or before, text[at:]
                if is_last:
                    out.append((before, restorer.parts(tail, before)))
                    before, tail = "", ""
                made.append((*stream, seq, out))
            if not is_last:
                open_[name] = (before, tail)
            elif name in held:  # a stream that has ended leaves nothing behind
                over.add(name)
        self.held.change(open_, over)
        tokens = {(session, token) for session, _, _, out in made for _, parts in out for token in parts[1::2]}
        originals = self.originals({(session, token): owned(session, restorer.name(token)) for session, token in tokens}, new)
        for session, _, _, out in made:
            for _, parts in out:
                parts[1::2] = [originals.get((session, token), token) for token in parts[1::2]]
        sessions, streams, seqs, outs = zip(*made) if made else ((), (), (), ())
        yield pd.DataFrame({"session_id": sessions, "stream_id": streams, "seq": pd.Series(seqs, dtype="int64"), "output": ["".join("".join(parts)[len(left):] for left, parts in out) for out in outs]})

    def originals(self, names: dict[tuple, str], new: dict[str, str]) -> dict[tuple, str]:
        """Originals of sessions' tokens, from a batch's own mappings and from those that the pages hold."""
        asked = set(names.values())
        found = {**self.known.look_up(asked - new.keys()), **{name: new[name] for name in asked & new.keys()}}
        return {token: found[name] for token, name in names.items() if found.get(name) is not None}

    def close(self) -> None:
        pass


class BucketRestorer(SessionRestorer):
    """SessionRestorer for groups of sessions whose rows come packed()."""

    def columns(self, frame: pd.DataFrame) -> Iterator[list[list]]:
        for piece in frame["packed"]:
            yield [c.to_numpy(zero_copy_only=False).tolist() for c in pa.ipc.read_record_batch(pa.py_buffer(piece), ROWS).columns]


@lru_cache(BUCKETS)
def owner(session: str | None) -> str:
    """How names of a session begin: no other session's names are the same, whatever follows."""
    return "0" if session is None else f"{len(session) + 1}={session}"


def owned(session: str | None, name: str | None) -> str:
    return owner(session) + ("" if name is None else f"={name}")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed) from batches of a bucket and the columns of ROWS: what a batch has of a bucket in one value."""
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        buckets, rows = buckets[order], batch.select(ROWS.names).cast(ROWS).take(pa.array(order))
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        packed_ = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, [*starts[1:], len(buckets)])]
        yield pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int32()), pa.array(packed_, pa.binary())], names=["bucket", "packed"])


def packed(rows: DataFrame) -> DataFrame:
    """(bucket, packed) from columns of ROWS; Spark hands rows and groups to a stateful processor one by one, so there should be few of both."""
    small_batches(rows.sparkSession)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.select(bucket, *ROWS.names).mapInArrow(pieces, "bucket int, packed binary")


def restore_sessions(mappings: DataFrame, chunks: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(session_id, stream_id, seq, output) from two streams: (session_id, placeholder, original) and (session_id, stream_id, seq, fragment, is_last).

    Mappings arrive as they are made; those of a batch are known to its fragments. No dictionary
    travels with the function, so a session may hold any number: a fragment looks up the placeholders
    that it holds. A task holds what a batch brings to one of BUCKETS groups of sessions; rows of a session
    that stand together cost least. Start the query within live_dictionary.rocksdb().
    """
    one = mappings.filter("placeholder IS NOT NULL").select("session_id", F.lit(True).alias("is_mapping"), F.col("placeholder").alias("name"), F.lit(0).cast("long").alias("seq"), F.col("original").alias("text"), F.lit(False).alias("is_last"))
    two = chunks.select("session_id", F.lit(False).alias("is_mapping"), F.col("stream_id").alias("name"), F.col("seq").cast("long").alias("seq"), F.col("fragment").alias("text"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    schema = StructType.fromDDL("session_id string, stream_id string, seq long, output string")
    return packed(one.unionByName(two)).groupBy("bucket").transformWithStateInPandas(BucketRestorer(prefix), schema, "Append", "None")


def restore_batch(chunks: DataFrame, mapping: Mapping[str, str], prefix: str = PREFIX) -> DataFrame:
    """restore_stream() of all fragments at once; one stream's fragments meet in one task, as their order is the result."""
    known = dict(mapping)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, current, before, tail = Restorer(known, prefix), None, "", ""
        for batch in batches:
            outs = []
            for stream, fragment, last in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "fragment", "is_last"))):
                if stream != current:
                    current, before, tail = stream, "", ""
                out, before, tail = restorer.feed(before, tail, fragment or "")
                if last:
                    out, before, tail = out + restorer.restore(tail, before), "", ""
                outs.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("seq"), pa.array(outs, pa.string())], names=["stream_id", "seq", "output"])

    return in_streams(chunks).select("stream_id", F.col("seq").cast("long").alias("seq"), "fragment", "is_last").mapInArrow(run, "stream_id string, seq long, output string")


def in_streams(rows: DataFrame) -> DataFrame:
    """rows by stream_id and seq, a stream whole in one task: tasks go through many short streams one after another, and a long one is never held."""
    small_batches(rows.sparkSession)
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq")


def session_stream(hits: DataFrame, ttl_seconds: int) -> DataFrame:
    """(original, placeholder, registered_at): registrations from a stream of hits (original, placeholder, at); a hit after the time to live registers anew.

    An original's state goes when the watermark has passed its time to live; hits that come later than that are late and left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, rows = state.get[0] if state.exists else None, []
        for r in pd.concat(list(frames)).sort_values("at").itertuples():
            if since is None or r.at - since > ttl_seconds:
                since = int(r.at)
                rows.append((key[0], r.placeholder, since))
        state.update((since,))
        state.setTimeoutTimestamp(max((since + ttl_seconds) * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=["original", "placeholder", "registered_at"])

    timed = hits.withColumn("time_", F.timestamp_seconds("at")).withWatermark("time_", f"{ttl_seconds} seconds")
    return timed.groupBy("original").applyInPandasWithState(run, "original string, placeholder string, registered_at long", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def eviction_stream(mappings: DataFrame, most: int) -> DataFrame:
    """(session_id, placeholder, created_at) of mappings that leave a full session, from a stream of (session_id, placeholder, created_at).

    Before one comes to a session that holds `most`, the oldest goes (the first placeholder of those of one time); state: what a session holds.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        heapq.heapify(held)
        known, rows = {name for _, name in held}, []
        for r in pd.concat(list(frames)).sort_values(["created_at", "placeholder"]).itertuples():
            if r.placeholder in known:
                continue
            while len(held) >= most:
                at, name = heapq.heappop(held)
                known.discard(name)
                rows.append((key[0], name, int(at)))
            heapq.heappush(held, (int(r.created_at), r.placeholder))
            known.add(r.placeholder)
        held.sort()
        state.update(([at for at, _ in held], [name for _, name in held]))
        yield pd.DataFrame(rows, columns=["session_id", "placeholder", "created_at"])

    return mappings.groupBy("session_id").applyInPandasWithState(run, "session_id string, placeholder string, created_at long", "at array<long>, names array<string>", "append", GroupStateTimeout.NoTimeout)


__all__ = ["Restorer", "eviction_stream", "restore_batch", "restore_sessions", "restore_stream", "session_stream"]
