import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, mixing, queries, token_orc
from palimpsest.llm.common import scratch_path

DOCS = "doc_id long, text string, source string, part string, ids string"
TRICKY = [
    "plain words, and more.\nNext line", "  two  blanks", "tab\there", "a\n\nb", "trailing ", " leading", "it's we'll\nI'm 'quoted'", "été çà nbsp x", "x y z", "123 4a5 a4 $$$ ###\n###",
    "<|endoftext|> said", "\n", " ", "a", "日本語 テキスト\n日本", "é combining", "mixed\r\nline", "nul\0in", "emoji 😀 ok", "word." * 3 + " " + "x" * 5000,
]


def test_encoder_equals_library(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.byte_bpe())
    ours = token_orc.PieceEncoder(whole.to_str())
    rng = random.Random(5)
    parts = [" the", " a", "\nB", " é1!", " don't", " aaaaa", " aaaaaaa", "\n中文字", "a", " x" * 3, " " + "q" * 300, " 𝒳y", "!!", "22", "'s", "ſ①_"]
    texts = [*TRICKY, None, "", *("w" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600))]
    texts.append(" ".join(t for t in texts[-400:]) * 3)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for chunk in (token_orc.CHUNK_BYTES, 3000):  # the second cuts long texts into parts
        monkeypatch.setattr(token_orc, "CHUNK_BYTES", chunk)
        ids, count = ours.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(count)
        for k, t in enumerate(texts):
            assert ids[ends[k] - count[k]:ends[k]].tolist() == want[k], t


def test_files_have_stripes_indexes_and_bloom_filters_that_prune(spark):
    path = scratch_path(spark, "t")
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('word', id, ' and ', id * 7) AS text")
    token_orc.write_tokens(docs, path, queries.byte_bpe(), stripe_bytes=20_000)
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(hadoop).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(hadoop))
        assert reader.getRowIndexStride() == 1000 and len(reader.getStripes()) > 1
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds = {s.getKind().toString() for s in rows.readStripeFooter(stripe).getStreamsList()}
            assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
        rows.close()

    def scanned(ids):
        found = token_orc.read_tokens(spark, path, ids)
        assert {r.doc_id for r in found.collect()} == {i for i in ids if i % 2 == 0}
        plan = found._jdf.queryExecution().executedPlan()
        leaves = (plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan).collectLeaves()
        return leaves.head().metrics().apply("numOutputRows").value()

    # a stripe holds a few thousand rows, a row group 1,000; an odd id lies between statistics, so only the filter says no
    assert 1 <= scanned([20_000]) <= 5000
    assert scanned([20_001]) < 20_000 / 4


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i * 3 % 41, t, None, "clash", None) for i, t in enumerate(TRICKY)] + [(2, None, "s", None, None), (2, "", "s", None, None), (7, "same", "s", None, None), (7, "same", "s", None, None), (None, "no id", None, None, None)]
    path = scratch_path(spark, "t")
    token_orc.write_tokens(spark.createDataFrame(rows, DOCS).repartition(5), path, queries.byte_bpe())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_orc.token_digests(spark, path).collect())
    tok, start, want = Tokenizer.from_file(queries.byte_bpe()), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert {r.doc_id for r in token_orc.read_tokens(spark, path, [7, 2]).collect()} == {2, 7}
    empty = scratch_path(spark, "t")
    token_orc.write_tokens(spark.createDataFrame([], DOCS), empty, queries.byte_bpe())
    assert token_orc.token_digests(spark, empty).count() == 0


def test_op1_on_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    docs, tok, start = queries.table(spark, sf_dir, "documents").orderBy("doc_id").collect(), Tokenizer.from_file(queries.byte_bpe()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_orc(spark, sf_dir).collect()}
    for d in docs:
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 0]
        assert got[d.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def brute(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for p in {tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
            for i in range(len(words) - len(p) + 1):
                if tuple(words[i:i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_op2_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_decontaminate(spark, sf_dir).collect()}
    assert set(got) == set(docs) and any(g[4] for g in got.values())
    for i, text in docs.items():
        assert got[i] == brute(text, items), i


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_cases(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_SHARE", 10)
    rng = np.random.default_rng(1)
    items = [(1, "a b"), (2, "c"), (10, "a a a"), (3, None), (4, "..."), (1, "b a c"), (None, "d d"), (None, "b b b"), (6, " ".join(rng.choice(list("abcd"), 90))), (5, " ".join(rng.choice(list("abcd"), 20)))]
    texts = [None, "", "c", "A! B", "x a b x", "a a a a", "b a c b", *(" ".join(rng.choice(list("abcdx"), n, p=[.3, .3, .2, .1, .1])) for n in rng.integers(1, 60, 40)), f"q {items[-1][1]} q"]
    docs = spark.createDataFrame([(i, t, "s", "p", "clash") for i, t in enumerate(texts)], DOCS).withColumnRenamed("ids", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.mark_contamination(docs, bench, block_bytes=block).collect()}
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, []).append(t)
    for i, t in enumerate(texts):
        want = brute(t, [(k, x) for k, v in by_item.items() for x in v])
        r = got[i]
        assert (r.n_words, r.n_hit, len(r["items"]), decontamination.item_digest([x for x in r["items"] if x is not None]), r.contaminated) == want, t
    assert decontamination.mark_contamination(docs.limit(0), bench).count() == 0
    assert decontamination.mark_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000 + items[-1][1] + " y" * 200_000, "s", "p", "c")], DOCS)
    assert [(r.n_words, r.n_hit >= 20, "5" in r["items"]) for r in decontamination.mark_contamination(long.drop("ids"), bench, block_bytes=block).collect()] == [(400_020, True, True)]
    assert decontamination.remove_spans("One two, three four!", [(1, 3)]) == "One  four!"


def mixed_by_hand(docs, total=1.5, cap=2.0, weights=(5, 2, 1)):
    """(doc_id, size, source_size, target, taken) of (doc_id, size, source) rows, by plain Python."""
    by = {}
    for d, n, s in docs:
        by.setdefault(s, []).append((d, n))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    size, weight = {s: sum(n for _, n in by[s]) for s in sources}, {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), total * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap * size[s]}
        if not full:
            target |= share
            break
        target |= {s: cap * size[s] for s in full}
        left -= sum(cap * size[s] for s in full)
        open_ -= full
    out = []
    for s in sources:
        copies = int(target[s] // size[s]) if size[s] else 0
        rest, heavy = target[s] - copies * size[s], lambda n: max(1, int(n**0.5))
        part = target[s] / size[s] - copies if size[s] else 0
        open_, taken = sorted((x for x in by[s] if x[1] and part > 0), key=lambda x: -heavy(x[1])), set()
        while open_:  # those with a probability of 1 or more are certain, the rest is dealt again
            weighed = sum(n * heavy(n) for _, n in open_)
            sure = [x for x in open_ if rest * heavy(x[1]) >= weighed]
            if not sure:
                break
            sure = [x for x in sure if heavy(x[1]) == heavy(sure[0][1])]
            taken |= set(sure)
            rest -= sum(n for _, n in sure)
            open_ = [x for x in open_ if x not in taken]

        def rank(x):
            u = (int(hashlib.md5(f"{mixing.SEED}|{x[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = rest * heavy(x[1]) / weighed
            return (u / (1 - u)) / (p / (1 - p))

        before = 0
        for x in sorted(open_, key=lambda x: (rank(x), x)):
            if before + x[1] / 2 > rest:
                break
            taken.add(x)
            before += x[1]
        out += [(d, n, size[s], target[s], n * (copies + ((d, n) in taken))) for d, n in by[s]]
    return out


def test_mixing_equals_brute_force(spark, sf_dir):
    rows = queries.op10_mix_sources(spark, sf_dir).collect()
    docs = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in queries.table(spark, sf_dir, "documents").collect()]
    want = {r[0]: r for r in mixed_by_hand(docs)}
    assert len(rows) == len(want) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (w[1], w[2], w[4]) and r.target == pytest.approx(w[3])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_mix_sources(spark, sf_dir).collect()))


def test_mixing_of_sources_with_few_and_large_documents(spark):
    rng = np.random.default_rng(4)
    sizes = [(s, int(n)) for s in range(30) for n in np.append(rng.integers(0, 40, rng.integers(1, 60)), rng.integers(100, 3000, rng.integers(0, 4)))]
    rows = [(k, n, None if s == 3 else f"s{s:02d}") for k, (s, n) in enumerate(sizes)]
    docs = spark.createDataFrame([(k, "w " * n, s) for k, n, s in rows], "doc_id long, text string, source string")
    for total, weights in ((1.5, (5, 2, 1)), (0.4, (1,))):
        want = {r[0]: r[4] for r in mixed_by_hand(rows, total, weights=weights)}
        assert {r.doc_id: r.taken for r in mixing.mix_sources(docs, total=total, weights=weights).collect()} == want


def test_mixing_edge_cases(spark):
    rows = [(1, "a b c", "x", None, None), (1, "a b c", "x", None, None), (2, None, None, None, None), (3, "", "y", None, None), (None, "d e", None, None, None), (4, "w " * 300, "x", None, None), (5, "w " * 200_000, "z", "clash", None)] + [(7, "one two", "t", None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"part": "rank", "ids": "size"}).withColumns({"large": F.lit("x"), "u": F.lit(1), "source_size": F.lit(2)})
    got = mixing.mix_sources(docs).collect()
    assert {r.n_copies for r in got if r.doc_id == 7} in ({0}, {1}, {2}) and {r.size for r in got if r.doc_id == 5} == {200_000}
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_pareto_order_draws_by_odds(spark):
    """A source of equal documents: as many as the target asks for, by the smallest random odds."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"))
    got = mixing.mix_sources(docs, total=0.5, weights=(1, 1)).collect()
    for s, n in (("a", 100), ("b", 300)):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == 400 and len(own) == n
    rank = {r.doc_id: int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) for r in got if r.source == "b"}
    taken = {r.doc_id for r in got if r.source == "b" and r.taken}
    assert taken == set(sorted(rank, key=rank.get)[:100])


def test_large_documents_are_drawn_by_their_odds(spark):
    """Inclusion rates over many sources alike: near the stated probabilities, whatever a document's share of its source."""
    sizes = [160, 90, 60, 40] + [10] * 40 + [4] * 30
    rows = [(s * 1000 + k, "w " * n, f"s{s:03d}") for s in range(250) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words, weighed = sum(sizes), sum(n * max(1, int(n**0.5)) for n in sizes)  # none is certain: 0.5 * 12 * 870 < 5796
    rate, taken = {}, {}
    for r in mixing.mix_sources(docs, total=0.5, weights=(1,)).collect():
        rate.setdefault(r.size, []).append(r.taken > 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for n in rate:
        p = min(1, 0.5 * max(1, int(n**0.5)) * words / weighed)
        assert abs(np.mean(rate[n]) - p) < 0.12, (n, p, np.mean(rate[n]))
    assert max(abs(v - words / 2) for v in taken.values()) <= 160 / 2


def test_index_of_a_short_text_with_a_large_vocabulary():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sigma, runs = int(rng.integers(50, 100_000)), int(rng.integers(1, 6))
        words = rng.integers(1, sigma, 6)
        text = np.concatenate([[0], *(np.append(rng.choice(words, int(rng.integers(1, 9))), 0) for _ in range(runs))])
        index, stream = decontamination.FMIndex(text, sigma), words.astype(np.int32)
        low, high = index.search(stream, np.arange(5), np.full(5, 2))
        for k in range(5):
            want = [i for i in range(len(text) - 1) if (text[i:i + 2] == words[k:k + 2]).all()]
            assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == want


def test_workers_read_no_vocabulary(monkeypatch):
    """What encoders need to know of a tokenizer comes with it: no worker makes Python objects of its file."""
    from palimpsest.llm.queries import byte_bpe

    with open(byte_bpe(), encoding="utf-8") as f:
        text = f.read()
    about, texts = token_orc.described(text), ["a b, c\nd", "", "two  blanks", None]
    whole = token_orc.PieceEncoder(text).encode(pa.array(texts))
    monkeypatch.setattr(token_orc, "json", None)
    ours = token_orc.PieceEncoder(about).encode(pa.array(texts))
    assert [x.tolist() for x in ours] == [x.tolist() for x in whole]
    assert token_orc.encoder(about, 5) is token_orc.encoder(token_orc.Described(text, about.by_piece, about.irregular, about.bytes_of), 5)


def test_words_are_remembered_without_their_marks():
    """What is remembered are words in Arrow, not a Python object for each piece."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(queries.byte_bpe()), random.Random(6)
    ours = token_orc.PieceEncoder(tok.to_str())
    words = [f"{a}{b}" for a in "abcdé" for b in ("x", "7", "日", "", "-", "ß", "'s", "!x")] + [""]
    texts = ["z" + "".join(rng.choice(" \n") + (rng.choice(words) + "".join(rng.choices(token_orc.MARKS, k=rng.choice([0, 1, 2, 8, 9, 12]))) or "q") for _ in range(400)) for _ in range(20)]
    for part in (pa.array(texts[:10]), pa.array(["sliced", *texts]).slice(1)):
        ids, count = ours.encode(part)
        for t, a, n in zip(part.to_pylist(), np.cumsum(count) - count, count):
            assert ids[a:a + n].tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert isinstance(ours.known, pa.Array)
    marked = ["m", *(" ".join(f"w{k}{a}{b}" for k in range(20)) for a in token_orc.MARKS for b in token_orc.MARKS)]
    before = len(ours.known)
    ours.encode(pa.array(["m " + t for t in marked]))
    assert len(ours.known) - before <= 25
