import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, licenses, line_rules, queries, warc
from palimpsest.llm.common import scratch_path

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op4_base_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op4_licenses(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.n_base for r in rows)
    for r in rows:
        words = plain(docs[r.doc_id])
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_near_notices(spark):
    texts = ["The MIT-License; mit license mit license", "under the Apache Licence 2", "GNU Generl Public Licens", "permit licenses", None, "", "é MIT\nLicens é", "no license", "mitt license, emit license"]
    got = {r.i: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert [x.word for x in got[0].base] == [1, 3, 5] and got[0].score == 1
    assert [(n.label, n.edits) for n in got[1].notices] == [("apache", 1)] and texts[1][got[1].notices[0].start:got[1].notices[0].end] == "Apache Licence"
    assert [(n.label, n.edits) for n in got[2].notices] == [("gpl", 2)]
    assert not got[3].notices and not got[4].notices and not got[5].notices and not got[7].notices
    assert [(n.label, n.first_word, n.end_word) for n in got[6].notices] == [("mit", 1, 3)]
    assert licenses.scan_licenses(spark.createDataFrame([], "i int, text string")).count() == 0


def test_other_notices(spark):
    texts = ["SPDX-License-Identifier: MPL-2.0", "Redistribution and use in source and binary form are", "Creative Commons Atribution 4.0", "the BSD License", "is license", "Mozilla Public Licence, v. 2.0\n" + "x " * 300_000 + "Permission is hereby granted, free of charge, to any person obtaining a copy", "Lesser General Public License"]
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)], "i int, text string, notices string, score double")
    got = {r.i: r for r in licenses.scan_licenses(docs).collect()}
    assert [sorted({n.label for n in got[i].notices}) for i in range(7)] == [["mpl"], ["bsd"], ["cc-by"], ["bsd"], [], ["mit", "mpl"], ["gpl", "lgpl"]]
    assert got[5].n_words == 300_000 + 6 + 13 and [b.label for b in got[6].base] == ["gpl"] and not got[3].base
    assert licenses.scan_licenses(docs).columns == ["i", "text", "n_words", "base", "notices", "score"]
    assert not any(r.notices for r in licenses.scan_licenses(docs.filter("i = 3"), notices=()).collect())


def test_near_notices_on_documents_equal_brute_force(spark, sf_dir):
    """Labels of the query: every phrase within its edits of some run of words, by edit distance at each start."""
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    phrases = [(p, label, len(p) // licenses.CHARS_PER_EDIT) for p, label in licenses.PHRASES] + [(p, label, len(p) // licenses.CHARS_PER_NOTICE_EDIT) for p, label in licenses.NOTICES] + [(p, label, 0) for p, label in licenses.IDENTIFIERS]

    def near(words, phrase, most):
        n = len(phrase.split())
        for i in range(len(words)):
            for k in range(max(1, n - most), n + most + 1):
                run = " ".join(words[i:i + k])
                if i + k <= len(words) and abs(len(run) - len(phrase)) <= most and distance(run, phrase) <= most:
                    return True
        return False

    rows = queries.op4_licenses(spark, sf_dir).collect()
    hits = [r for r in rows if r.labels]
    for r in [*hits[:4], *[r for r in rows if not r.labels][:3]]:
        words = plain(docs[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == {label for p, label, most in phrases if near(words, p, most)}, r.doc_id


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_op7_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, removed_words, kept FROM ({line_rules.ORACLE_SQL})").fetchall()
    got = queries.op7_line_rules(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_line_rules_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    common, own = " ".join(f"x{i}" for i in range(80)), " ".join(f"v{i}" for i in range(60))
    rows = [(i, f"{long}\n Common   LINE {common}\n{own} end {i}", "h") for i in range(25)] + [(30, None, None), (31, "", "h"), (32, "a a a a a a", "h"), (32, "a a a a a a", "h"), (None, "x\ny\nx\n \nx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_rules(docs.withColumns({c: F.lit("clash") for c in ("line", "lines", "words", "host", "i", "h", "t", "n_words", "text_hash", "kept")})).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, line_rules.line_rules(docs).collect()))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert not by[3].base_failed and by[3].removed_words == 142 and not by[3].kept  # 60 + 82 of 204 words are in frequent lines
    assert (by[32].n_repeat_words, by[30].n_words, by[31].n_words) == (6, 0, 0)
    assert (by[None].n_dup_lines, by[None].n_words) == (2, 4)
    assert all(r.kept for r in line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=25).collect() if r.doc_id and r.doc_id < 25)
    assert line_rules.line_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line {k % 400_000} of a log" for k in range(500_000))
    row = line_rules.line_rules(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (row.n_words, row.n_dup_lines, row.line_words) == (2_500_000, 100_000, 2_000_000)


def test_very_long_text_takes_the_other_sort(spark, monkeypatch):
    monkeypatch.setattr(line_rules, "PLACE_BITS", 4)
    docs = spark.createDataFrame([(1, "a b c d a b c " + " ".join(map(str, range(30))), "h"), (2, "a b c a b c", "h")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_repeat_words for r in line_rules.line_rules(docs).collect()} == {1: 6, 2: 6}


@pytest.mark.parametrize("bits", [line_rules.PLACE_BITS, 59])
def test_repeats_are_exact_whatever_hashes_do(spark, monkeypatch, bits):
    """With 59 bits of place, only 5 are left to tell windows apart, so most texts hold equal hashes of different windows."""
    monkeypatch.setattr(line_rules, "PLACE_BITS", bits)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "a b c", "a b c a b c", " ".join(map(str, range(3000))) + " 1 2 3"]
    docs = spark.createDataFrame([(i, t, "h", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    for r in line_rules.line_rules(docs).collect():
        w = (texts[r.doc_id] or "").split()
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}), texts[r.doc_id]


def test_op8_equals_digests_of_turns(spark, sf_dir):
    turns = {}
    for r in queries.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    got = queries.op8_chat(spark, sf_dir).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        learned = "".join(t or "" for role, t in turns[r.conv_id] if role == "assistant")
        assert r.n_turns == len(turns[r.conv_id]) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t or ''}\n" for a, t in turns[r.conv_id]).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(t or "") for _, t in turns[r.conv_id])


def test_chat_round_trip(spark):
    odd = ["", "\\", "\\\\", "###", "####", "</turn>", "<</turn>\n", "</turn>\n### user:\nhi\n</turn>\n", "\n", "é\\n", "ends \\", ":", None, "x" * 100_000]
    rows = [(c, t, r, x) for c, n in ((1, 3), (2, 40)) for t in range(n) for r, x in [(["user", "assistant", "a:\nb\\", None][t % 4], odd[(t + c) % len(odd)])]] + [(None, None, "assistant", "null"), (None, 0, None, None), (2, 5, "user", "again"), (2, 5, "user", "again")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = docs.withColumns({c: F.lit("clash") for c in ("c", "t", "r", "x", "piece", "formatted", "loss", "first_turn")})
    pieces = chat.format_turns(clashing.repartition(7))
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(c, []).append(((r or "").encode(), (x or "").encode()))
    got, loss = {}, {}
    for p in sorted(pieces.collect(), key=lambda p: (p.first_turn is not None, p.first_turn or 0, p.piece)):
        got.setdefault(p.conv_id, []).extend(chat.parsed(p.formatted.encode()))
        loss.setdefault(p.conv_id, []).extend(chat.unescaped(p.formatted.encode()[x.start:x.end]) for x in p.loss)
    assert got == want
    assert loss == {c: [x for r, x in turns if r == b"assistant"] for c, turns in want.items()}
    digests = {r.conv_id: r for r in chat.conversation_digests(pieces).collect()}
    assert digests[2].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for r, x in want[2])).hexdigest() and digests[2].n_turns == 42
    assert chat.conversation_digests(chat.format_turns(docs.limit(0))).count() == 0


def expected_records(rows):
    best = {}
    for i, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and (p not in best or best[p] is None or i is not None and i > best[p]):
            best[p] = i
    n = {}
    for _, html in rows:
        n[(html or "").encode()] = n.get((html or "").encode(), 0) + 1
    out = []
    for i, html in rows:
        p = (html or "").encode()
        again = n[p] > 1 and p in best and i != best[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None))
    return sorted(out, key=repr)


def test_op9_equals_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in queries.table(spark, sf_dir, "pages").collect()]
    assert sorted(map(tuple, queries.op9_warc(spark, sf_dir).collect()), key=repr) == expected_records(rows)


@pytest.mark.parametrize("request_bytes", [100, 1 << 20])
def test_warc_cases(spark, request_bytes):
    asked = {"request_bytes": str(request_bytes)}
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, big), (9, big), (4, big), (9, big), (None, big), (2, None), (3, ""), (5, "short"), (6, "short"), (7, big + "x"), (8, "y" * 999), (10, "y" * 999), (11, "z" * 3_000_000), (12, "z" * 3_000_000)]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}\r\nx", h, "clash") for i, h in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "w")
    warc.write_pages(pages.repartition(2), path, range_bytes="3000", file_bytes="4000")
    assert len(list(Path(path.removeprefix("file://")).glob("*.warc"))) > 2
    assert sorted(map(tuple, warc.page_records(spark, path, **asked).collect()), key=repr) == expected_records(rows)
    one = warc.read_archive(spark, path, **asked).filter(F.col("record_id") == "<urn:page:7>")
    assert [r.payload.decode() for r in one.collect()] == [big + "x"]
    assert warc.read_archive(spark, path, payload=False, **asked).filter("payload is not null").count() == 0
    assert warc.read_archive(spark, path).filter("record_type in ('revisit') and target_uri is not null").count() == 4
    empty = scratch_path(spark, "w")
    warc.write_pages(pages.limit(0), empty)
    assert warc.page_records(spark, empty).count() == 0
    # a second write adds to the first; archives without a list are read whole
    warc.write_pages(pages, empty)
    warc.write_pages(pages.filter("page_id = 5"), empty)
    assert sorted(map(tuple, warc.page_records(spark, empty, **asked).collect()), key=repr) == sorted([*expected_records(rows), *expected_records([(5, "short")])], key=repr)
    for x in Path(empty.removeprefix("file://")).glob(f"{warc.MANIFEST}*"):
        x.unlink()
    assert warc.page_records(spark, empty, **asked).count() == len(rows) + 1


@pytest.mark.parametrize("wanted,left", [("record_type", 0), ("payload_length", 1)])
def test_pushed_filters(wanted, left):
    reader = warc.WarcReader("/nowhere", True)
    assert len(list(reader.pushFilters([warc.EqualTo((wanted,), "x")]))) == left
