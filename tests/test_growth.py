"""What a query holds, moves or starts must not follow the input's size."""

import contextlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import byte_segments, engine, keyword_join, requests, restore
from palimpsest.streaming import events, restorer


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("block", [keyword_join.BROADCAST_KEYWORDS, 0])
def test_keywords_in_blocks_move_no_text(spark, monkeypatch, block):
    monkeypatch.setattr(keyword_join, "BROADCAST_KEYWORDS", block)
    docs = spark.createDataFrame([(1, "abcabc é abab ababab"), (1, "abab é"), (None, "éabc"), (None, "abc \x1babcabc"), (2, None), (3, "😀 abc")], "doc_id int, text string")
    words = spark.createDataFrame([("abc", "X"), ("abab", "Y"), ("abab", None), ("bc", "Z")] + [(f"w{k}", "N") for k in range(40)], "keyword string, category string")
    hits = keyword_join.keyword_hits(docs, words)
    assert "Exchange" not in plan(hits)
    want = {(r.doc_id, r.keyword, r.category): (r.n, r.s) for r in hits.groupBy("doc_id", "keyword", "category").agg(F.count("*").alias("n"), F.min("start").alias("s")).collect()}
    got = keyword_join.keyword_totals(docs, words).collect()
    assert len(got) == len(want) and {(r.doc_id, r.keyword, r.category): (r.n, r.first_start) for r in got} == want
    assert want[(1, "abab", None)] == (3, 0) and want[(3, "abc", "X")] == (1, 5) and want[(None, "bc", "Z")] == (4, 1)
    once = keyword_join.keyword_totals(docs.filter("doc_id > 1"), words)
    assert "Exchange" not in plan(once) and once.count() == 2


def test_streams_share_a_task_without_a_call_each(spark):
    known = {"__VG_NAME_0123456789ab__": "Alice"}
    parts = ["hi __VG_NAM", "E_0123456789ab__", " and __VG"]
    chunks = spark.createDataFrame([(f"s{i}", k, p, k == 2) for k, p in enumerate(parts) for i in range(3000)] + [(None, 0, "x", True)], "stream_id string, seq long, fragment string, is_last boolean")
    made = restorer.restore_batch(chunks, known)
    assert "FlatMapGroups" not in plan(made)
    whole = made.groupBy("stream_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", "output"))), lambda x: x["output"])).alias("w"))
    assert {(r.w, r.n) for r in whole.groupBy("w").agg(F.count("*").alias("n")).collect()} == {("hi Alice and __VG", 3000), ("x", 1)}
    body = 'data: {"delta":"__VG_NAME_01234","type":"x.delta"}\n\ndata: {"delta":"56789ab__","type":"x.delta"}\n\ndata: [DONE]\n\n'
    out = events.restore_events(spark.range(3000).select(F.col("id").cast("string").alias("stream_id"), F.lit(body).alias("body")), known)
    assert "FlatMapGroups" not in plan(out)
    got = {(r.seq, r.event, r.n) for r in out.groupBy("seq", "event").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 'data: {"delta":"","type":"x.delta"}', 3000), (1, 'data: {"delta":"Alice","type":"x.delta"}', 3000), (2, "data: [DONE]", 3000)}


def test_bytes_are_looked_at_in_pieces(monkeypatch):
    values = pa.array([b"a\xffb" * 40, None, b"", b"x" * 500, b"\x1b[0mz"] * 20, pa.binary())
    whole, sizes = byte_segments.segments_of(values).to_pylist(), []
    some = byte_segments.segments_of_some
    monkeypatch.setattr(byte_segments, "TOGETHER", 600)
    monkeypatch.setattr(byte_segments, "segments_of_some", lambda v: sizes.append(sum(len(x or b"") for x in v.to_pylist())) or some(v))
    assert byte_segments.segments_of(values).to_pylist() == whole and len(sizes) > 10 and max(sizes) <= 600


def test_python_gets_small_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    spark.range(1).select(requests.decode_body(F.lit(b"x"), F.array(F.lit("")))).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_texts_that_repeat_are_worked_out_once(spark, monkeypatch):
    people = engine.PiiEngine(bytes(32), [], [("Alice", "NAME"), ("Bob", "NAME"), ("lice", "PART")])
    texts = ["hi Alice, Bob", "x Bob", None, "", "é Bob é Bob", "none"]
    docs = spark.range(1200).select(F.when(F.col("id") % 5 > 0, 1200 - F.col("id")).alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 6 + 1).cast("int")).alias("text"), F.lit("kept").alias("hits_met"))
    detect, sizes = engine.PiiEngine.detect, []
    monkeypatch.setattr(engine.PiiEngine, "detect", lambda self, rows, *a: sizes.append(rows.count()) or detect(self, rows, *a))

    def made():
        red, mapping = people.redact_with_mapping(docs, "doc_id", created_at=F.timestamp_seconds(F.coalesce("doc_id", F.lit(-1))))
        out = people.restore(red.withColumn("n", F.size("hits")).drop("hits"), mapping, "redacted")
        return [out.columns, mapping.columns, sorted(map(repr, out.collect())), sorted(map(repr, mapping.collect()))]

    once = made()
    monkeypatch.setattr(engine, "REPEATED", 10_000)
    assert made() == once and sizes == [len(texts), 1200]


def test_tokens_of_a_text_cost_one_split_for_each_pattern(spark):
    docs = spark.createDataFrame([("__VG_NAME_0123456789ab__ é VG_NAME_0123456789ab__ " * 3000,)], "text string")
    found = docs.select(F.explode(restore.tokens(F.col("text"))).alias("t"))
    assert plan(found).count("split(") <= len(restore.patterns())
    assert found.count() == 6000 and found.agg(F.max("t.end")).first()[0] == 3000 * 51 - 1
