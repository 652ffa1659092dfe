import zlib

import numpy as np

import corpus_pipeline
from palimpsest.llm import queries
from test_jaccard_join import brute as brute_groups
from test_tokens_decontamination_mixing import brute as brute_contamination


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage's rows from the rows before it, by plain Python."""
    from tokenizers import Tokenizer

    docs, columns = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "documents").columns
    bench = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "stage")
        kept.append(docs.collect())
        if len(kept) < 5:
            assert docs.columns == columns, name
    everything = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    assert all(any(c.isalpha() for c in r.text) for r in kept[0]) and len(kept[0]) >= len(everything) * 0.97
    assert {r.doc_id for r in kept[1]} == {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in kept[0]]) if i == c}
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1] if not brute_contamination(r.text, bench)[4]}
    taken = {}
    for r in kept[3]:
        assert r == everything[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    words = {r.doc_id: len(r.text.split()) for r in kept[2]}
    assert set(taken) <= set(words) and max(taken.values()) <= 2
    assert abs(sum(words[i] * n for i, n in taken.items()) / sum(words.values()) - 1.5) < 0.05
    tok, start, want = Tokenizer.from_file(queries.byte_bpe()), 0, []
    for r in sorted(kept[3], key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, kept[4]), key=lambda r: r[1]) == want


def test_pipeline_takes_odd_and_empty_rows(spark, sf_dir):
    rows = [(1, "the and thing " * 30, "en", None, None), (1, "the and thing " * 30, "en", None, None), (2, None, None, None, None), (None, "thing of the and " * 30, "en", "s", 3), (3, "", "en", "s", 0), (4, "###", None, "s", 3)]
    clash = ("lang_pred", "score", "spans", "items", "rank", "id", "i", "x", "n_words", "row_in_hand", "name", "size")
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    rows = [(*r, *[f"{c} {k}" for c in clash]) for k, r in enumerate(rows)]
    given = {tuple(r[1:]) for r in rows}
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == columns and {tuple(r[1:]) for r in docs.collect()} <= given, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
