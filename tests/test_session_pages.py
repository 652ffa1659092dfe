"""A session's state: calls to the store don't follow the entries, and what it holds is what was put there."""

import random

import pandas as pd
import pyarrow as pa

from palimpsest.streaming import pages, restorer


class Store:
    """A map state in a dictionary, which counts calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


class Handle:
    def __init__(self):
        self.stores = {}

    def getMapState(self, name, *schemas):
        return self.stores.setdefault(name, Store())


def test_pages_hold_what_was_put(monkeypatch):
    monkeypatch.setattr(pages, "PAGE", 4)
    rng, handle, model = random.Random(1), Handle(), {}
    book, names = pages.Pages(handle, "x"), [f"é{k}" for k in range(300)]
    for _ in range(300):
        put = {name: rng.choice([None, "a\n\0é", ["", "t"]]) for name in rng.sample(names, rng.choice([0, 1, 40]))}
        gone = {name for name in rng.sample(names, rng.choice([0, 5, 150])) if name not in put}
        book.change(put, gone)
        model = {name: value for name, value in {**model, **put}.items() if name not in gone}
        asked = rng.sample(names, 30)
        assert book.look_up(asked) == {name: model[name] for name in asked if name in model}
    book.change({}, set(names))
    assert not handle.stores["x"].held


def rows(mappings, fragments):
    """Rows of one session as restore_sessions() makes them."""
    made = [("s", True, name, 0, original, False) for name, original in mappings] + [("s", False, *f) for f in fragments]
    return iter([pd.DataFrame(made, columns=["session_id", "is_mapping", "name", "seq", "text", "is_last"])])


def test_calls_to_the_store_do_not_follow_mappings_and_streams():
    handle, processor = Handle(), restorer.SessionRestorer("__VG_")
    processor.init(handle)
    name = lambda k: f"__VG_WORD_{k:012x}__"
    streams = [f"s{k}" for k in range(200)] + [None]
    first = [(s, 0, f"a {name(k)} {name(k + 2000)[:9]}", False) for k, s in enumerate(streams)]
    out = pd.concat(processor.handleInputRows(("s",), rows([(name(k), f"w{k}") for k in range(2000)] + [(name(9), None)], first), None))
    assert list(out.output[:2]) == ["a w0 ", "a w1 "] and out.output[9] == f"a {name(9)} "
    second = [(s, 2, f" {name(k)[2:-2]}", True) for k, s in enumerate(streams)] + [(s, 1, name(k + 2000)[9:], None) for k, s in enumerate(streams)]
    out = pd.concat(processor.handleInputRows(("s",), rows([(name(2000), "late")], [(s, q, t, bool(x)) for s, q, t, x in second]), None))
    whole = out.sort_values("seq").groupby("stream_id", dropna=False).output.sum()
    assert whole["s0"] == "late w0" and whole["s7"] == f"{name(2007)} w7" and len(whole) == 201 and whole[whole.index.isna()].iloc[0] == f"{name(2200)} w200"
    assert not handle.stores["held"].held
    assert sum(store.calls for store in handle.stores.values()) < 150


def test_calls_to_the_store_do_not_follow_sessions():
    """A group holds many sessions: their rows come packed, their pages are shared, their dictionaries and streams are apart."""
    handle, processor = Handle(), restorer.BucketRestorer("__VG_")
    processor.init(handle)
    name, sessions = "__VG_WORD_0123456789ab__", [f"c{k}" for k in range(300)] + ["", "=", "1", None]

    def ran(rows):
        table = pa.Table.from_pylist([dict(zip(["bucket", *restorer.ROWS.names], (k % 2, *row))) for k, row in enumerate(rows)], pa.schema([("bucket", pa.int32()), *restorer.ROWS]))
        pieces = list(restorer.pieces(table.to_batches(400)))
        assert sum(p.num_rows for p in pieces) == 2 * len(table.to_batches(400)) and all(p.column("bucket").to_pylist() == [0, 1] for p in pieces)
        return pd.concat(processor.handleInputRows((0,), iter([p.to_pandas() for p in pieces]), None))

    out = ran([(s, True, name, 0, f"<{s}>", False) for s in sessions] + [(s, False, t, 0, f"a {name[:9]}", False) for s in sessions for t in ("s", None)])
    assert len(out) == 2 * len(sessions) and set(out.output) == {"a "}
    out = ran([(s, False, t, 1, f"{name[9:]} {name}", True) for s in sessions for t in ("s", None)])
    assert sorted(map(repr, zip(out.session_id, out.stream_id, out.output))) == sorted(repr((s, t, f"<{s}> <{s}>")) for s in sessions for t in ("s", None))
    assert not handle.stores["held"].held
    assert sum(store.calls for store in handle.stores.values()) < 30
    assert list(restorer.pieces(iter([pa.RecordBatch.from_pylist([], pa.schema([("bucket", pa.int32()), *restorer.ROWS]))])))[0].num_rows == 0
