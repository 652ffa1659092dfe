"""Server-sent events: framing, parsing and restoration of text that comes in deltas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dictionary import PREFIX
from .restorer import MOST_MAPPINGS, Restorer, fragments_in_order, in_streams


def split_events(body: Column) -> Column:
    """The events of a whole body: parts between blank lines."""
    return F.filter(F.split(body, r"\r?\n\r?\n", -1), lambda e: e != "")


def with_fields(events: DataFrame) -> DataFrame:
    """events with name, data (lines joined; one leading blank of each taken away), is_terminal, is_delta and delta of the column event.

    What others refer to is a column of its own, worked out once.
    """
    of = lambda field: F.transform(F.filter("lines_", lambda x: x.startswith(field)), lambda x: F.regexp_replace(F.substring(x, len(field) + 1, 1 << 30), "^ ", ""))
    rows = events.withColumn("lines_", F.split("event", r"\r?\n"))
    rows = rows.withColumns({"name": F.coalesce(F.trim(F.try_element_at(of("event:"), F.lit(-1))), F.lit("")), "data": F.array_join(of("data:"), "\n")}).drop("lines_")
    rows = rows.withColumns({"kind_": F.coalesce(F.get_json_object("data", "$.type"), F.lit("")), "text_": F.get_json_object("data", "$.delta"), "nested_": F.get_json_object("data", "$.delta.text")})
    ends = lambda c: F.lower(c).rlike("done|completed|complete")
    delta = F.when(F.col("name").contains("delta") | F.col("kind_").contains("delta"), F.coalesce("nested_", F.when(~F.coalesce("text_", F.lit("")).startswith("{"), F.col("text_"))))
    made = rows.withColumns({"is_terminal": (F.trim("data") == "[DONE]") | ends(F.col("name")) | ends(F.col("kind_")), "delta": delta})
    return made.select(*events.columns, "name", "data", "is_terminal", F.col("delta").isNotNull().alias("is_delta"), "delta")


class EventRestorer:
    """Of one stream: deltas are restored across events, each held until the next event; others on their own."""

    def __init__(self, mapping: Mapping[str, str], prefix: str = PREFIX):
        self.restorer, self.before, self.tail, self.pending = Restorer(mapping, prefix), "", "", None

    def feed(self, row: dict) -> list[str]:
        out = []
        if row["is_terminal"]:
            out += self.flush()
        if row["is_delta"]:
            if self.pending:
                out.append(self.text(*self.pending))
            made, self.before, self.tail = self.restorer.feed(self.before, self.tail, row["delta"])
            self.pending = (row, made)
        else:
            if self.pending:
                out.append(self.text(*self.pending))
                self.pending = None
            out.append(self.restorer.restore(row["event"]))
        return out

    def flush(self) -> list[str]:
        if not self.pending:
            return []
        row, made = self.pending
        made += self.restorer.restore(self.tail, self.before)
        self.pending, self.before, self.tail = None, "", ""
        return [self.text(row, made)]

    @staticmethod
    def text(row: dict, delta: str) -> str:
        """The event with its delta replaced, its data on one line."""
        value = json.loads(row["data"])
        if isinstance(value["delta"], dict):
            value["delta"]["text"] = delta
        else:
            value["delta"] = delta
        kept = [x for x in row["event"].replace("\r\n", "\n").split("\n") if not x.startswith("data:")]
        return "\n".join([*kept, "data: " + json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)])


def parsed_events(streams: DataFrame) -> DataFrame:
    """(stream_id, seq, event and its fields) of whole bodies (stream_id, body)."""
    return with_fields(streams.select("stream_id", F.posexplode(split_events(F.col("body"))).alias("seq", "event")))


def restore_events(streams: DataFrame, mapping: Mapping[str, str], prefix: str = PREFIX) -> DataFrame:
    """(stream_id, seq, event): events as they go out; one stream is one task's, as its order is the result."""
    known = dict(mapping)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, current, n, begun, made = EventRestorer(known, prefix), None, 0, False, []

        def put(events: list[str]) -> None:
            nonlocal n
            made.extend((current, n + k, e) for k, e in enumerate(events))
            n += len(events)

        def taken() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * 3
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["stream_id", "seq", "event"])

        for batch in batches:
            for stream, event in zip(batch.column("stream_id").to_pylist(), batch.column("event").to_pylist()):
                if not begun or stream != current:
                    put(r.flush() if begun else [])
                    current, n, begun = stream, 0, True
                    r.before, r.tail, r.pending = "", "", None
                put(r.feed(read_event(event)))
            yield taken()
        if begun:
            put(r.flush())
            yield taken()

    rows = in_streams(streams.select("stream_id", F.posexplode(split_events(F.col("body"))).alias("seq", "event")))
    return rows.mapInArrow(run, "stream_id string, seq long, event string")


BREAK = re.compile(r"\r?\n\r?\n")
ENDS = re.compile("done|completed|complete", re.IGNORECASE)


def read_event(event: str) -> dict:
    """What with_fields() says of an event's text."""
    lines = re.split(r"\r?\n", event)
    of = lambda field: [re.sub("^ ", "", x[len(field):]) for x in lines if x.startswith(field)]
    names, data = of("event:"), "\n".join(of("data:"))
    name = names[-1].strip(" ") if names else ""
    try:
        value = json.loads(data)
    except ValueError:
        value = None
    kind, delta = (value.get("type") or "", value.get("delta")) if isinstance(value, dict) else ("", None)
    text = delta.get("text") if isinstance(delta, dict) else delta
    shown = isinstance(text, str) and ("delta" in name or isinstance(kind, str) and "delta" in kind)
    ends = data.strip(" ") == "[DONE]" or bool(ENDS.search(name)) or isinstance(kind, str) and bool(ENDS.search(kind))
    return {"event": event, "data": data, "is_terminal": ends, "is_delta": shown, "delta": text if shown else None}


def restore_event_stream(chunks: DataFrame, mapping: Mapping[str, str], prefix: str = PREFIX) -> DataFrame:
    """(stream_id, seq, event): events as they go out, from a stream of (stream_id, seq, fragment, is_last) cut anywhere.

    State, until the last fragment: the part of an event that has come, the delta that waits for the
    next event, and the restorer's tail. seq numbers a stream's events as they go out.
    """
    if len(mapping) > MOST_MAPPINGS:
        raise ValueError(f"a session holds {MOST_MAPPINGS} mappings at most")
    known = dict(mapping)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = EventRestorer(known, prefix)
        buffer, r.before, r.tail, pending, n = state.get if state.exists else ("", "", "", "", 0)
        r.pending = tuple(json.loads(pending)) if pending else None
        out, over = [], False
        for row in fragments_in_order(frames).itertuples():
            buffer += row.fragment or ""
            over = bool(row.is_last)
            *whole, buffer = BREAK.split(buffer)
            if over:
                whole, buffer = [*whole, buffer], ""
            for event in whole:
                if event:
                    out += r.feed(read_event(event))
            if over:
                out += r.flush()
        if not over:
            state.update((buffer, r.before, r.tail, json.dumps(r.pending) if r.pending else "", n + len(out)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": range(n, n + len(out)), "event": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, event string", "buffer string, before string, tail string, pending string, n long", "append", GroupStateTimeout.NoTimeout)
