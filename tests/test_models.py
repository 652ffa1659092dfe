"""Kernels against small models in plain Python, on random cases."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.operators import jsonprompt, ner, requests, restore, spans
from palimpsest.operators.engine import PiiEngine
from palimpsest.sources.rules import Rule, RuleList
from palimpsest.streaming.restorer import Restorer

KEY = bytes(range(32))


def greedy(cands):
    taken = []
    for c in sorted(cands, key=lambda c: (-c[3], c[0] - c[1], c[0], c[5], c[2])):
        if all(c[1] <= t[0] or t[1] <= c[0] for t in taken):
            taken.append(c)
    return sorted(taken)


def split(cands):
    covered, out = set(), []
    for c in sorted(cands, key=lambda c: (-c[0], -c[1], c[5])):
        run = [i for i in range(c[0], c[1]) if i not in covered]
        for i in run:
            if i - 1 not in run:
                end = i
                while end in run:
                    end += 1
                out.append((i, end, c[2]))
        covered |= set(range(c[0], c[1]))
    return sorted(out)


def test_overlap_resolution(spark):
    rng = random.Random(1)
    cases = []
    for i in range(150):
        cands = []
        for k in range(rng.randint(0, 7)):
            a = rng.randint(0, 18)
            cands.append((a, a + rng.randint(1, 8), rng.choice("ABC"), rng.choice([40, 50, 100]), "s", k, "x"))
        cases.append((i, cands, "abcdefghijklmnopqrstuvwxyz"))
    rows = spark.createDataFrame(cases, f"id int, c {spans.NONE}, text string")
    for r in rows.select("id", "c", spans.greedy(F.col("c")).alias("g"), spans.split_resolution(F.col("c"), F.col("text")).alias("s")).collect():
        cands = [tuple(x) for x in r.c]
        assert sorted(map(tuple, r.g)) == greedy(cands)
        assert sorted((x.start, x.end, x.category) for x in r.s) == split(cands)
        assert all(x.original == "abcdefghijklmnopqrstuvwxyz"[x.start:x.end] for x in r.s)


def segments(text):
    out, at, start = [], 0, 0
    raw = text.encode()
    for m in re.finditer(r"\x1b\[[^@-~]*(?:[@-~]|\Z)|\x1b[\]PX^_].*?(?:\x07|\x1b\\|\Z)|\x1b.?|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​﻿­]", text, re.DOTALL):
        a, b = len(text[: m.start()].encode()), len(text[: m.end()].encode())
        out.append((at, raw[at:a].decode()))
        at = b
    return [s for s in [*out, (at, raw[at:].decode())] if s[1]]


def test_segments_of_reference_inputs_and_random_texts(spark):
    rng = random.Random(2)
    texts = ["foo\x1b[90mbar\x1b[0mbaz", "A​B", None, ""] + ["".join(rng.choice("aé\n\t\x1b[]0m\x07\\\x00​") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", spans.safe_segments(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [tuple(x) for x in r.s] == segments(texts[r.id] or ""), repr(texts[r.id])
    assert [(x.off, x.off + len(x.seg)) for x in rows[0].s] == [(0, 3), (8, 11), (15, 18)]


def test_redaction_properties_and_round_trip(spark):
    rng = random.Random(3)
    words = ["Alice", "Bob", "é", "x", "a@b.co", "10.0.0.1", "Alice Bob", "\x1b[0m", "4111 1111 1111 1111"]
    # two characters between words: a hit takes the one after it, so the next needs its own
    texts = ["; ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    engine = PiiEngine(KEY, keywords=[("Alice", "NAME"), ("Alice Bob", "PAIR"), ("Bob", "NAME")])
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    red, mapping = engine.redact_with_mapping(docs, "id")
    for r in red.collect():
        raw = r.text.encode()
        for a, b in zip(r.hits, r.hits[1:]):
            assert a.end <= b.start
        assert all(raw[h.start:h.end].decode() == h.original for h in r.hits)
        assert "Alice" not in r.redacted and "a@b.co" not in r.redacted
    assert {r.id: r.restored for r in engine.restore(red.select("id", "redacted"), mapping, "redacted").collect()} == dict(enumerate(texts))


def test_stream_output_does_not_depend_on_cuts():
    rng = random.Random(4)
    mapping = {"__VG_NAME_0123456789ab__": "Alice", "__VG_A_B_ffffffffffff__": "é x", "__VG_NAME_0123456789ab_2__": "Bob"}
    r = Restorer(mapping)
    parts = ["hi ", "__VG_NAME_0123456789ab__", "VG_NAME_0123456789ab__", " ", "_", "__V", "__VG_A_B_ffffffffffff", ", ", "__VG_NAME_0123456789ab_2__", "__VG_x_", "é"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        before, tail, out, at = "", "", "", 0
        while at < len(text):
            n = rng.randint(1, 9)
            made, before, tail = r.feed(before, tail, text[at:at + n])
            out, at = out + made, at + n
        assert out + r.restore(tail, before) == r.restore(text), text


def test_batch_and_stream_restore_alike(spark):
    mapping = {"__VG_NAME_0123456789ab__": "Alice", "__VG_A_B_ffffffffffff__": "é x"}
    texts = ["a __VG_NAME_0123456789ab__ b VG_A_B_ffffffffffff", "_VG_NAME_0123456789ab__", "VG_NAME_0123456789ab", "x" * 50, "__VG_NAME_0123456789ab__\n__VG_NAME_0123456789ab__", "__VG_NAME_0123456789ab____VG_A_B_ffffffffffff__"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.restored for r in restore.restore(docs, spark.createDataFrame(list(mapping.items()), "placeholder string, original string"), "text").collect()}
    assert got == {i: Restorer(mapping).restore(t) for i, t in enumerate(texts)}


def test_json_walk():
    body = '{"type":"response.create","metadata":{"note":"Alice"},"input":[{"role":"user","content":[{"type":"input_text","text":"hello Alice"}]}]}'
    assert jsonprompt.prompts(body) == ["hello Alice"] and jsonprompt.rebuilt(body, str) == body
    assert jsonprompt.prompts('{"a":1} x') is None and jsonprompt.prompts('{"a":NaN}') is None and jsonprompt.prompts(None) is None
    assert jsonprompt.rebuilt('{"b":1.50,"messages":"<x>"}', lambda s: "<y>") == '{"b":1.50,"messages":"\\u003cy\\u003e"}'


def test_decoding_limits():
    import gzip

    assert requests.decoded(gzip.compress(b"x" * 100), ["gzip"], 99) is None and requests.decoded(gzip.compress(b"x" * 100), ["gzip"], 100) == b"x" * 100
    assert requests.decoded(None, []) is None and requests.decoded(b"x", []) == b"x"


def test_entities_fail_open(spark):
    def broken(texts):
        raise RuntimeError

    rows = spark.createDataFrame([("Alice",)], "text string")
    assert rows.select(ner.recognizer(broken)(F.col("text")).alias("f")).first().f == []
    assert rows.select(ner.analyze_url(F.lit("http://h/analyze/?x#y")).alias("u")).first().u == "http://h/analyze"
    assert rows.select(ner.analyze_url(F.lit("ftp://h")).alias("u")).first().u is None


def test_rule_priority_between_lists(spark):
    lists = [RuleList([Rule("keyword", "LOW", "abc def")], "low", 10), RuleList([Rule("keyword", "HIGH", "def")], "high", 90)]
    out = PiiEngine(KEY, lists).detect(spark.createDataFrame([("abc def",)], "text string")).first()
    assert [h.category for h in out.hits] == ["HIGH"]
