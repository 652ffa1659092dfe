import re

import numpy as np
import pytest

from palimpsest.llm import jaccard_join as jj, queries


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(n_shingles, component) of each (doc_id, text), by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    by, root = {}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in by[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if rows[k][0] is not None and rows[j][0] is not None and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])))
                root[b] = a
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def check(spark, rows, monkeypatch=None):
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, members string").repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute([r[:2] for r in rows]), key=repr)


def family(rng, n, words, edits, vocabulary=3000):
    base = rng.integers(0, vocabulary, words)
    for _ in range(n):
        copy = base.copy()
        copy[rng.integers(0, words, rng.integers(0, edits + 1))] = rng.integers(0, vocabulary)
        yield " ".join(f"w{x}" for x in copy)


def mixture(rng):
    texts = []
    for words in (1, 2, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 50, 80, 130, 300):
        for edits in (1, 2, 4, max(2, words // 25)):
            texts += family(rng, 4, words, min(edits, words))
    texts += [t + " tail of other words " * k for k, t in enumerate(texts[100:110])]
    return texts


def test_equals_brute_force_on_families(spark):
    rng = np.random.default_rng(7)
    check(spark, [(int(i), t, "x") for i, t in zip(rng.permutation(10_000) - 50, mixture(rng))])


def test_crowded_families_and_shared_passages(spark):
    """Families larger than a crowd, some near the threshold, and a passage that most documents hold."""
    rng = np.random.default_rng(8)
    texts = [*family(rng, 120, 100, 3), *family(rng, 90, 60, 2)]
    passage = " ".join(f"p{x}" for x in range(60))
    for _ in range(150):
        own = " ".join(f"w{x}" for x in rng.integers(0, 3000, rng.integers(15, 120)))
        texts.append(f"{own} {passage}")
    texts += ["Exact  copy of\tone two three four five six"] * 60 + ["exact copy of one two three four five six"] * 3
    check(spark, [(int(i), t, None) for i, t in zip(rng.permutation(5000), texts)])


@pytest.mark.parametrize("told_apart", [jj.TOLD_APART, 30])
def test_blocks_find_what_is_left(spark, monkeypatch, told_apart):
    """With almost no room and tiny crowds many documents are compared in blocks, by sketches and by texts."""
    monkeypatch.setattr(jj, "TOLD_APART", told_apart)
    monkeypatch.setattr(jj, "TEXT_BLOCK", 3)
    monkeypatch.setattr(jj, "CROWD", 2)
    monkeypatch.setattr(jj, "ROOM", (0.0, 0.0))
    monkeypatch.setattr(jj, "BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(i, t, None) for i, t in enumerate([*mixture(rng)[::3], *family(rng, 12, 40, 2)])]
    check(spark, rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(10)
    memory = jj.WordHashes()
    texts = [t.encode() for t in [*family(rng, 6, 200, 12), *family(rng, 6, 900, 300)]]
    sets, starts = jj.shingle_sets([jj.words_of(t) for t in texts], 1, memory)
    bits = jj.sketches(sets, starts)
    for i in range(len(texts)):
        for j in range(i):
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(jj.exact_set(texts[i]) ^ jj.exact_set(texts[j]))


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (3, " \n\t", None), (4, "One", "x"), (5, "one", None), (6, "one two", None), (None, "one", None), (None, None, None), (7, "é " * 9, None), (8, "É " * 9, None),
            (9, "a b c d e f", None), (9, "g h i j k l m", None), (10, "a b c d e f", None), (11, "g h i j k l m", None), (11, "g h i j k l m", None), (-3, "a\x0bb\x0cc\rd e f", None), (12, "word " * 30_000, None)]
    check(spark, rows)
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op3_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, d, "documents").collect()]
    got = queries.op3_jaccard_join(spark, d)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute(rows))


@pytest.mark.parametrize("size", [1, 3, 4, 7, 8, 9, 20, 21, 100, 999, 20_000])
def test_allocation_leaves_room(size):
    """Without empty segments, segments and double ones exceed what linked sets can differ in."""
    starts = jj.band_starts(size)
    for a, b in zip(starts, starts[1:]):
        m, g = jj.allocation(a, b, *jj.ROOM)
        assert g <= m and m + g >= jj.most_different((b - 1) + (b - 1) * 100 // 80) + 1
        assert (b - 1) * 100 // 80 < b * 100 // 80 + 1
