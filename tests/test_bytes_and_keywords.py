"""Byte segments, keyword joins and the live dictionary against plain Python."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import byte_segments, keyword_join, spans
from palimpsest.operators.dictionary import build_mapping
from palimpsest.operators.engine import PiiEngine
from palimpsest.scratch import scratch_path
from palimpsest.streaming import live_dictionary as live

KEY = bytes(range(32))


def escape_length(b):
    if b[:1] != b"\x1b":
        return 0
    if b[1:2] == b"[":
        return next((i + 1 for i in range(2, len(b)) if 0x40 <= b[i] <= 0x7E), len(b))
    if b[1:2] and b[1:2] in b"]PX^_":
        ends = (i + 1 if b[i] == 7 else i + 2 for i in range(2, len(b)) if b[i] == 7 or b[i:i + 2] == b"\x1b\\")
        return next(ends, len(b))
    return min(2, len(b))


def segments(b):
    """One step after another: an escape, a character, or one invalid byte."""
    out, start, i = [], None, 0
    while i < len(b):
        n, bad = escape_length(b[i:]), True
        if not n:
            n = 1
            for k in (1, 2, 3, 4):
                try:
                    c = b[i:i + k].decode()
                except UnicodeDecodeError:
                    continue
                n, bad = k, unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\r\t"
                break
        if bad and start is not None:
            out.append((start, b[start:i].decode()))
        start = None if bad else i if start is None else start
        i += n
    return out + ([(start, b[start:].decode())] if start is not None else [])


def test_byte_segments_equal_a_decoder_step_by_step():
    rng = random.Random(7)
    parts = [b"a", "é".encode(), "日".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f", b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x1b", b"[", b"]", b"m", b"\x07", b"\\", b"\n", b"\x00", "​".encode(), "\x85".encode(), "\U000e0001".encode(), b"0"]
    values = [None, b"", b"\x41\xff\x42", b"\x1b\xc3\xa9x", b"\x1b", b"\x1b[1", b"a\x1b]0;x"] + [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = byte_segments.segments_of(pa.array(values, pa.binary())).to_pylist()
    for v, g in zip(values, got):
        assert [(x["off"], x["seg"]) for x in g] == segments(v or b""), v
    assert byte_segments.segments_of(pa.array(values, pa.binary()).slice(5, 20)).to_pylist() == got[5:25]
    assert byte_segments.segments_of(pa.array([], pa.binary())).to_pylist() == []


def test_bytes_are_redacted_between_invalid_ones(spark):
    raw = b"\xff mail a@b.co\xfe and caf\xc3\xa9 x@y.zz \xc3"
    docs = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, body binary")
    out = {r.id: r for r in PiiEngine(KEY).redact(docs, "body").collect()}
    made = bytes(out[1].redacted)
    assert re.fullmatch(rb"\xff mail __VG_EMAIL_[0-9a-f]{12}__\xfe and caf\xc3\xa9 __VG_EMAIL_[0-9a-f]{12}__ \xc3", made) and out[2].redacted is None


@pytest.mark.parametrize("broadcast", [keyword_join.BROADCAST_KEYWORDS, 0])
def test_keyword_table_finds_what_each_keyword_finds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(keyword_join, "BROADCAST_KEYWORDS", broadcast)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbé日 ") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [None, "", "\x1b[0maaaa\x00aaa", "a" * 5000]
    words = [("aa", "X"), ("aba", "Y"), ("a", "Z"), ("a", "Z2"), ("é日", "W"), ("a" * 70, "L"), ("zzzz", "N"), ("", None), (None, "Q"), ("aa", "X")] + [("".join(rng.choice("abé日") for _ in range(rng.randint(1, 12))), "R") for _ in range(60)]
    want = set()
    for i, t in enumerate(texts):
        for off, seg in segments((t or "").encode()):
            for word, category in {w for w in words if w[0]}:
                for m in re.finditer(re.escape(word), seg):
                    a = off + len(seg[:m.start()].encode())
                    want.add((i, word, category, a, a + len(word.encode())))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id int, text string, keyword string").repartition(3)
    listed = spark.createDataFrame(words, "keyword string, category string")
    got = list(map(tuple, keyword_join.keyword_hits(docs, listed).collect()))
    assert len(got) == len(want) and set(got) == want
    twice = keyword_join.keyword_hits(docs.unionByName(docs), listed)
    assert twice.count() == 2 * len(want) and twice.columns == ["doc_id", "keyword", "category", "start", "end"]
    assert keyword_join.keyword_hits(docs, listed.limit(0)).count() == 0 and keyword_join.keyword_hits(docs.limit(0), listed).count() == 0


def run_live(spark, batches, **options):
    """Events after each batch; the query stops and starts again for each."""
    kind = "session_id string, doc_ord long, start int, category string, original string, at long"
    source, out, checkpoint = (scratch_path(spark, n) for n in ("hits", "events", "state"))
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        with live.rocksdb(spark):
            live.dictionary_stream(spark.readStream.schema(kind).parquet(source), KEY, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.EVENTS).parquet(out), spark.createDataFrame([r for b in batches for r in b], kind)


def test_live_dictionary_restarts_to_the_batch_mapping(spark):
    rng = random.Random(8)
    rows = [(s, d, rng.randrange(50), rng.choice("AB"), f"o{rng.randrange(12)}", d) for d in range(40) for s in ("x", "y") for _ in range(2)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    events, hits = run_live(spark, [[r for r in rows if r[1] < 15], [r for r in rows if r[1] >= 15]])
    held = {(r.session_id, r.original): (r.category, r.placeholder, r.created_at) for r in live.standing(events).collect()}
    for s in ("x", "y"):
        own = hits.filter(F.col("session_id") == s).withColumn("created_at", F.timestamp_seconds("at"))
        batch = build_mapping(own, KEY).withColumn("created_at", F.unix_seconds("created_at"))
        assert {r.original: (r.category, r.placeholder, r.created_at) for r in batch.collect()} == {o: v for (x, o), v in held.items() if x == s}


def test_live_dictionary_evicts_and_expires(spark):
    rows = [[("s", 1, 0, "A", "a", 1), ("s", 2, 0, "A", "b", 2), ("s", 3, 0, "A", "c", 3), ("s", 4, 0, "A", "a", 4)], [("s", 5, 0, "B", "b", 5), ("s", 6, 0, "A", "c", 50)]]
    events, _ = run_live(spark, rows, most=2)
    got = [(r.event, r.original, r.created_at) for r in events.collect()]
    # a leaves for c, b for a, c for b, a for c
    assert sorted(got) == sorted([("registered", "a", 1), ("registered", "b", 2), ("evicted", "a", 1), ("registered", "c", 3), ("evicted", "b", 2), ("registered", "a", 4), ("evicted", "c", 3), ("registered", "b", 5), ("evicted", "a", 4), ("registered", "c", 50)])
    timed, _ = run_live(spark, [*rows, [("t", 7, 0, "A", "z", 500)], [("t", 8, 0, "A", "z", 501)]], ttl_seconds=10)
    left = {(r.session_id, r.original, r.created_at) for r in live.standing(timed).collect()}
    assert left == {("t", "z", 500)} and ("expired", "c", 3) in {(r.event, r.original, r.created_at) for r in timed.collect()}
