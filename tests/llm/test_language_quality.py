import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id, quality_crf, queries
from palimpsest.llm.common import LongTable


def longest_match_phrases(text, sample):
    """Greedy phrases, each the longest that occurs in sample (by brute force)."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("lane, overlap", [(language_id.LANE, language_id.OVERLAP), (40, 40), (16, 3), (5, 1)])
def test_automaton_finds_longest_matches(monkeypatch, lane, overlap):
    """Whatever the lanes are; short overlaps often don't meet."""
    monkeypatch.setattr(language_id, "LANE", lane)
    monkeypatch.setattr(language_id, "OVERLAP", overlap)
    rng = np.random.default_rng(2)
    for _ in range(10):
        samples = [rng.integers(1, 4, 60).tolist() for _ in range(3)]
        keys, to, starts, states = [], [], [], 0
        for sample in samples:
            go = language_id.suffix_automaton(sample)
            keys += [states + s << language_id.SYMBOL_BITS | c for s, edges in enumerate(go) for c in edges]
            to += [states + x for edges in go for x in edges.values()]
            starts.append(states)
            states += len(go)
        texts = [rng.integers(1, 5, n).astype(np.int32) for n in (0, 1, int(rng.integers(1, 80)), 512, 513, 2000, 5000)]
        model = language_id.LanguageModel(["x", "y", "z"], np.zeros(1, np.int32), LongTable(np.array(keys, np.int64)), np.array(to), np.array(starts), np.ones(3))
        assert model.phrases(texts).tolist() == [[longest_match_phrases("".join(map(chr, t.tolist())), "".join(map(chr, s))) for s in samples] for t in texts]


def test_long_table():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n))
        table = LongTable(keys)
        known = {k: i for i, k in enumerate(keys.tolist())}
        asked = np.concatenate([keys, keys + 1])
        assert table.find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]


def test_op5_equals_brute_force(spark, sf_dir, monkeypatch):
    """Every prediction of the query from phrases counted by substring search."""
    docs = queries.table(spark, sf_dir, "documents")
    samples, build = [], language_id.suffix_automaton
    monkeypatch.setattr(language_id, "suffix_automaton", lambda s: samples.append("".join(map(chr, s))) or build(s))
    model = language_id.learn_languages(language_id.learning_rows(docs, "doc_id", "text", "lang"))
    assert len(samples) == len(model.languages)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in queries.op5_language(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts):
        symbols = model.symbols(texts[i] or "").tolist()
        if rows[i].lang_pred == language_id.UNKNOWN:
            assert not any(c.isalpha() for c in texts[i] or "")
            continue
        rate = [longest_match_phrases("".join(map(chr, symbols)), s) / len(symbols) / r for s, r in zip(samples, model.rates)]
        assert rows[i].lang_pred == model.languages[int(np.argmin(rate))]
        assert np.isclose(rows[i].score, 1 / sum(np.exp(-(x - min(rate)) * len(symbols) ** 0.5) for x in rate))


def test_many_scripts_and_languages():
    """Two languages of a thousand ideographs beside one of many letters; and 300 languages."""
    rng = np.random.default_rng(11)
    alphabets = {"a": [chr(0x3400 + k) for k in range(154)], "b": [chr(0x4E00 + k) for k in range(1000)], "c": [chr(0x6000 + k) for k in range(1000)]}
    words = {k: ["".join(rng.choice(v, 3)) for _ in range(400)] for k, v in alphabets.items()}
    text = lambda k: " ".join(rng.choice(words[k], 60))
    model = language_id.learn_languages([(k, text(k)) for k in words for _ in range(48)])
    for k in words:
        asked = [model.symbols(text(k)) for _ in range(50)]
        rate = model.phrases(asked) / np.array([[len(x)] for x in asked]) / model.rates
        assert [model.languages[j] for j in rate.argmin(1)] == [k] * 50
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)] for k in range(300)}
    model = language_id.learn_languages([(k, text(k)) for k in words for _ in range(8)])
    assert len(model.languages) == 300
    asked = [model.symbols(text(k)) for k in words]
    rate = model.phrases(asked) / np.array([[len(x)] for x in asked]) / model.rates
    assert [model.languages[j] for j in rate.argmin(1)] == list(words)


def test_op5_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op5_language(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_language_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words.split(), 60)), lang, "x") for i, (words, lang) in enumerate([("the and thing of to in", "en"), ("der und nicht das ist ein", "de")] * 8)]
    rows += [(100, None, "en", None), (101, "", None, None), (102, "123 !?", "de", None), (None, "the thing", "en", None), (103, " ".join(rng.choice("the and thing of to in".split(), 30_000)), "de", None), (104, "Das nicht und", None, None), (104, "Das nicht und", None, None), (105, "漢字" * 200, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.learn_languages(language_id.learning_rows(docs, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.identify_language(docs, model, keep=["doc_id"]).withColumn("out", language_id.rejected()).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, None, 103, 104)] == ["und", "und", "und", "en", "en", "de"]
    assert got[101].score == 0 and got[100].out and got[105].out and not got[103].out and not got[104].out
    assert language_id.identify_language(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "letters", "rate"]
    empty = docs.limit(0)
    none = language_id.learn_languages(language_id.learning_rows(empty, "doc_id", "text", "lang"))
    assert language_id.identify_language(empty, none).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(docs, none).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    owner = np.array([0, 0, 0, 0, 1, 2, 2])
    scores, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    gamma, pairs, logz = quality_crf.forward_backward(scores, trans, quality_crf.chains(owner))
    want, want_pairs, total = np.zeros((7, 2)), np.zeros((2, 2)), 0.0
    for k in range(3):
        rows = np.flatnonzero(owner == k)
        weights = {}
        for code in range(2 ** len(rows)):
            y = [(code >> i) & 1 for i in range(len(rows))]
            weights[tuple(y)] = np.exp(sum(scores[r, s] for r, s in zip(rows, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for y, p in weights.items():
            for r, s in zip(rows, y):
                want[r, s] += p / z
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += p / z
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs) and np.isclose(logz, total)


def test_op6_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()}
    rows = queries.op6_quality(spark, d).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert len(rows) == queries.table(spark, d, "documents").count()


def test_op6_equals_brute_force(spark, sf_dir):
    """Scores of the query from the model's weights, each text by itself and line by line in plain Python."""
    docs = queries.table(spark, sf_dir, "documents")
    model = quality_crf.learn_quality(quality_crf.learning_rows(docs, queries.table(spark, sf_dir, "labels"), "doc_id", "text", "quality"))
    got = {r.doc_id: r for r in queries.op6_quality(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:60]:
        x, _, size = quality_crf.line_features([texts[i].encode()])
        s = [sum(w * (f - m) / d for w, f, m, d in zip(model.weights, row, model.mean, model.spread)) for row in x.tolist()]
        ahead, behind = [], [np.zeros(2)]
        for k, v in enumerate(s):  # log sums over the lines before, and over those after
            before = np.array([np.logaddexp(*(ahead[-1] + model.trans[:, y])) for y in (0, 1)]) if k else np.zeros(2)
            ahead.append(before + np.array([0.0, v]))
        for v in reversed(s[1:]):
            behind.append(np.array([np.logaddexp(*(model.trans[y] + np.array([0.0, v]) + behind[-1])) for y in (0, 1)]))
        both = [a + b for a, b in zip(ahead, reversed(behind))]
        good = [1 / (1 + np.exp(b[0] - b[1])) for b in both]
        p = min(max(sum(g * n for g, n in zip(good, size)) / sum(size), 1e-9), 1 - 1e-9)
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-(model.slope * np.log(p / (1 - p)) + model.shift))), atol=1e-6), i


def test_quality_cases(spark):
    rows = [(i, "Good plain words here.\nAnd more of them." if i % 2 else "### $$$ BUY!! BUY!! BUY!!\n### BUY!!") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n \n"), (103, "Good plain words.\n" * 5000), (None, "x"), (5, "Good plain words here.\nAnd more of them.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, None), (41, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = quality_crf.learn_quality(quality_crf.learning_rows(docs, labels, "doc_id", "text", "quality"))
    got = {r.doc_id: r for r in quality_crf.score_quality(docs, model).collect()}
    assert got[1].predicted == 1 and got[0].predicted == 0 and got[103].score > got[0].score
    assert got[100].score == got[101].score == got[102].score
    assert quality_crf.score_quality(docs.limit(0), model).count() == 0
    flat = quality_crf.learn_quality(quality_crf.learning_rows(docs, labels.limit(0), "doc_id", "text", "quality"))
    assert {r.score for r in quality_crf.score_quality(docs, flat).collect()} == {0.5}
