import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.operators import spans
from palimpsest.operators.dictionary import derived_key, hmac_sha256, random_key
from palimpsest.operators.engine import PiiEngine
from palimpsest.sources.rules import Config, Rule, RuleError, RuleList, builtin_rules, default_rules, groups, java_pattern, merge_keywords, parse_rules, secret_keywords, split_at_group


def test_rule_text():
    rules = parse_rules("# c\n; c\n! c\n// c\n\n  keyword my-cat John Doe \nK\tORG\tExample Corp\nRegEx  mail (?i)a@b\n", priority=200)
    assert rules.rules == [Rule("keyword", "MY_CAT", "John Doe"), Rule("keyword", "ORG", "Example Corp"), Rule("regex", "MAIL", "(?i)a@b")]
    assert (rules.priority, rules.keyword_count, rules.regex_count) == (99, 2, 1)
    assert RuleList([], priority=0).priority == 50 and len(default_rules().rules) == 24 and len({r.category for r in default_rules().rules}) == 21
    assert [r.category for r in builtin_rules("email", "mac").rules] == ["EMAIL", "MAC"]


@pytest.mark.parametrize("bad", ["keyword A", "regex", "word A b", "regex A (?=x)", "regex A (?<!x)y", r"regex A (a)\1", "regex A (a", "regex A a)", "regex A a++", "keyword -- x", "regex A [a", r"regex A \Cx", "keyword A " + "x" * (1 << 20)])
def test_one_bad_line_rejects_the_list(bad):
    with pytest.raises(RuleError):
        parse_rules("keyword OK fine\n" + bad)


@pytest.mark.parametrize("re2,java", [("a$", r"(?d)a\z"), (r"\$[$]", r"(?d)\$[$]"), ("(?i)k", "(?d)(?iu)k"), ("(?P<n>a)", "(?d)(?<n>a)"), ("[[:alpha:]_]", r"(?d)[\p{Alpha}_]"), ("[a[b]", r"(?d)[a\[b]"), ("[a&&b]", r"(?d)[a\&&b]"), ("[]a]", r"(?d)[\]a]")])
def test_translation(re2, java):
    assert java_pattern(re2) == java


def test_groups():
    assert split_at_group(r"(?:^|\D)(\d+)(?:$|\D)") == (r"(?:^|\D)", r"\d+", r"(?:$|\D)")
    assert split_at_group("abc") == ("", "abc", "") and split_at_group("(?i)abc") == ("(?i)", "abc", "")
    assert split_at_group("(a)?b") is None and split_at_group("((a)b)") is None and split_at_group("(a)(b)") is None and split_at_group("(?:(a)|b)") is None and split_at_group("(a)|b") is None


def test_optional_groups_take_the_whole_match(spark):
    rules = [RuleList([Rule("regex", "X", "k(a)?b"), Rule("regex", "Y", "(?:(c)|d)")])]
    rows = spark.createDataFrame([(1, "é kab kb cd"), (2, None)], "id int, text string").withColumn("segments", spans.safe_segments(F.col("text")))
    got = rows.select("id", F.explode(spans.detect("segments", rules)).alias("c")).select("c.start", "c.end", "c.category", "c.original").collect()
    assert sorted(map(tuple, got)) == [(4, 5, "X", "a"), (7, 9, "X", "kb"), (10, 11, "Y", "c"), (11, 12, "Y", "d")]


def random_pattern(rng):
    """An RE2 pattern with groups, flags of their own, bars and letters of one to three bytes."""
    atom = lambda: rng.choice(["k", "é", "日", "S", "s", ".", r"\w", r"\W", "[ké]", "[^s]", r"[\d日]", r"\b", "K", r"\Qk.\E"])

    def part(depth):
        made = "".join(atom() + rng.choice(["", "", "", "?", "+", "{1,2}"]) if rng.random() < 0.6 or depth > 2 else group(depth) for _ in range(rng.randint(1, 3)))
        return made + ("|" + part(depth + 1) if rng.random() < 0.2 else "")

    def group(depth):
        return rng.choice(["(", "(?:", "(?i:", "(?s:", "(?-i:", "(?:(?i)"]) + part(depth + 1) + ")" + rng.choice(["", "", "?"])

    made = part(0)
    return rng.choice(["", "", "(?i)"]) + re.sub(r"(\\b)[?+]|(\\b)\{1,2\}", r"\1\2", made)


def test_random_rules_find_what_re2_finds(spark, monkeypatch):
    import duckdb
    import random

    rng = random.Random(9)
    texts = ["".join(rng.choice("kKsSé日É. x1\n") for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["SECRET=abc secret=x", "kéx", "ã x zzéè"]
    patterns = [r"(?i:secret)=(\w+)", r"(?:(k.)|zz)", r"(?:([éè]+)|zz)", r"x(?i)(K|s)", *(random_pattern(rng) for _ in range(60))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want, used = {}, []
    for p in patterns:
        first = 1 if groups(p) else 0
        rows = con.execute("SELECT id, regexp_extract_all(text, ?, 0), regexp_extract_all(text, ?, ?) FROM t", [p, p, first]).fetchall()
        found = [(i, whole if part is None else part) for i, wholes, parts in rows for whole, part in zip(wholes, parts)]
        want[len(used)] = sorted(x for x in found if x[1])
        used.append(Rule("regex", "R", p))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("segments", spans.safe_segments(F.col("text")))
    for prefilters in (True, False):
        monkeypatch.setattr(spans, "PREFILTERS", prefilters)
        found = {k: [] for k in want}
        for r in rows.select("id", "text", F.explode(spans.detect("segments", [RuleList(used)])).alias("c")).collect():
            assert r.text.encode()[r.c.start:r.c.end].decode() == r.c.original
            found[r.c.rule_ord].append((r.id, r.c.original))
        for k, p in enumerate(used):
            assert sorted(found[k]) == want[k], (p.pattern, prefilters)


@pytest.mark.parametrize("pattern,literal", [("(?i:secret)=", "="), ("(?i)abc", None), ("a(?i:b(?-i:cd)e)f", "cd"), ("[[:alpha:]]+x", None), (r"\Qa.b\E+", "a."), ("(?:ab|ac)dd", "dd"), ("x{0,3}yz", "yz"), ("(?i:ⓐ)1", "1")])
def test_what_every_match_holds(pattern, literal):
    assert spans.required(pattern)[0] == literal


def test_cost_is_linear_in_hits(spark):
    import time

    def seconds(engine, n, unit):
        docs = spark.createDataFrame([(unit * n,)], "text string")
        began = time.time()
        found = engine.redact(docs).select(F.size("hits").alias("n")).first().n
        assert found >= n
        return time.time() - began

    for engine, unit in ((PiiEngine(bytes(range(32)), [], keywords=[("aa", "A"), ("ab", "B"), ("bb", "C")]), "aab bb "), (PiiEngine(bytes(range(32))), "u1@ex.com; ")):
        seconds(engine, 2000, unit)
        few, many = seconds(engine, 5000, unit), seconds(engine, 20_000, unit)
        assert many < 4 * few * 2


def test_keywords_with_odd_characters(spark):
    words = [("a.b", "P"), ("\\E$", "Q"), ("it's", "R"), ("aa", "S")]
    rows = spark.createDataFrame([("x a.b a_b \\E$ it's aaaa",)], "text string").withColumn("segments", spans.safe_segments(F.col("text")))
    got = rows.select(F.explode(spans.detect("segments", [], words)).alias("c")).select("c.start", "c.original").collect()
    assert sorted(map(tuple, got)) == [(2, "a.b"), (10, "\\E$"), (14, "it's"), (19, "aa"), (21, "aa")]


def test_excludes_come_before_overlaps_and_categories_are_names(spark):
    rules = parse_rules("keyword LONG secret word\nkeyword SHORT word")
    docs = spark.createDataFrame([("a secret word here",)], "text string")
    key = bytes(range(32))
    both = PiiEngine(key, [rules]).redact(docs).first()
    assert [h.category for h in both.hits] == ["LONG"]
    out = PiiEngine(key, [rules], excludes=["secret word"]).redact(docs).first()
    assert [h.category for h in out.hits] == ["SHORT"] and re.fullmatch(r"a secret __VG_SHORT_[0-9a-f]{12}__ here", out.redacted)
    assert PiiEngine(key, [], [("word", "W")]).overlap == "split"


def test_keys(spark):
    import hashlib
    import hmac

    for key in (bytes(range(32)), b"k" * 100):
        assert spark.range(1).select(hmac_sha256(key, F.lit("é"))).first()[0] == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    assert derived_key(b"s", "a") != derived_key(b"s", "b") and len(derived_key(b"s", "a")) == len(random_key()) == 32


def test_config():
    merged = Config([("a", "A")], ["x"], wal=True, prefix="__P_").merge(Config([("b", "B")], ["y"], ner_enabled=True, ner_entities=["ORG"], wal=False, prefix=""))
    assert (merged.keywords, merged.excludes, merged.ner_enabled, merged.ner_entities, merged.wal, merged.prefix) == ([("a", "A"), ("b", "B")], ["x", "y"], True, ["ORG"], True, "__P_")
    assert Config(ner_min_score=7).ner_min_score == 1.0 and Config(intercept_mode="odd").intercept_mode == "global"
    assert merge_keywords([("s", "C")], [("s", "DOTENV"), ("t", "DOTENV")]) == [("s", "C"), ("t", "DOTENV")]


def test_durations_and_secret_lines(spark):
    assert [fn.parse_duration(x, -1) for x in ("24h", "7d", "1h30m", "250ms", "x", "")] == [86400, 604800, 5400, 0.25, -1, -1]
    rows = spark.createDataFrame([(x,) for x in (" a long secret ", "# no", "short", "a long secret")], "value string")
    assert [tuple(r) for r in secret_keywords(rows, "lines").collect()] == [("a long secret", "SECRET_FILE")]


def test_configuration_changes():
    config = Config()
    config.add_keyword(" a​b ", "my cat")
    config.add_keyword("c")
    config.update_keyword(1, "d", "x")
    config.delete_keyword(0)
    assert config.keywords == [("d", "X")]
    config.add_rule_list("k A word", "mine")
    with pytest.raises(RuleError):
        config.add_rule_list("bad", "mine")
    assert [r.name for r in config.rule_lists] == ["mine"] and config.rule_lists[0].keyword_count == 1
    config.delete_rule_list("mine")
    assert config.rule_lists == []


def test_framed_log_files(spark, tmp_path):
    from palimpsest.sources import logs

    (tmp_path / "a.wal").write_bytes(logs.framed([b"one", b"", b"three"]) + b"\x00\x00")
    got = logs.read_framed_log(spark, str(tmp_path)).select("seq", "entry").collect()
    assert [(r.seq, bytes(r.entry)) for r in got] == [(0, b"one"), (1, b""), (2, b"three")]
    assert logs.follow(spark, str(tmp_path)).isStreaming


def test_settings_files_are_read_again_when_they_change(tmp_path):
    from palimpsest.sources.settings import ConfigFile

    one, two = tmp_path / "global.yaml", tmp_path / "project.yaml"
    (tmp_path / "a.rules").write_text("k A word")
    one.write_text("proxy: {placeholder_prefix: __P_}\npatterns: {keywords: [{value: sealed, category: c}], rule_lists: [{path: a.rules, enabled: true}]}\nsession: {ttl: 1h, max_mappings: 9}\n")
    files = ConfigFile(one, two, opened=lambda v: {"sealed": "open", "lost": None}.get(v, v))
    assert (files.config.keywords, files.config.prefix, files.config.max_mappings, [r.name for r in files.config.rule_lists]) == ([("open", "C")], "__P_", 9, ["a.rules"])
    assert not files.refresh()
    two.write_text("patterns: {keywords: [{value: more}, {value: lost}]}\n")
    assert files.refresh() and files.config.keywords == [("open", "C"), ("more", "TEXT")] and files.config.max_mappings == 9
    two.write_text("patterns: [")
    assert not files.refresh() and len(files.config.keywords) == 2


def test_plans_detect_once(spark, sf_dir):
    """Each of the 24 rules stands once in a plan: neither filters nor generators ask for hits again."""
    from palimpsest.plans import QUERIES

    for name in ("match_spans", "redact_documents", "redaction_stats", "placeholders", "resolve_greedy", "audit_match_preview"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("rulelist:") == 24, name


def test_rules_ask_for_digits_and_marks_first(spark, monkeypatch):
    """What a rule needs is known through branches and classes, rules that need a digit ask for one together, and no hit is lost by it."""
    asked = {r.category: (spans.required(r.pattern)[1], spans.needs_digit(r.pattern)) for r in default_rules().rules if r.category in ("IPV6", "MAC", "CHINA_ID", "IBAN", "EMAIL", "CREDIT_CARD")}
    assert asked == {"EMAIL": (r"[\@]", False), "CHINA_ID": (None, True), "CREDIT_CARD": (None, True), "IBAN": (None, True), "IPV6": (r"[\:]", False), "MAC": (r"[\-\:]", False)}
    assert not any(map(spans.needs_digit, (r"(\d?x)", r"(\d|x)", r"([^\d]+)", r"(?:\d{0,3}y)", r"([[:digit:]]+)", r"([\dx])"))) and all(map(spans.needs_digit, (r"(\d|[13]a)", r"(?:x1|y\d)z", r"([0-9]{2,})")))
    texts = ["call TEL : +49 30 1234567", "Token " + "x" * 24, "TOKEN " + "y" * 24, "bearer\t" + "z" * 30, "a@b.co", "::1 x", " 1:2:3:4:5:6:7:8 ", "00-11-22-aa-bb-cc", "aa:bb:cc:dd:ee:ff", "4111 1111 1111 1111", "DE89370400440532013000", "1.2.3.4", "bc1" + "q" * 30 + " 1" + "A" * 30, "0x" + "aB" * 20, "١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦٧٨", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("segments", spans.safe_segments(F.col("text")))
    found = lambda: sorted(map(repr, rows.select("id", F.explode(spans.detect("segments", [default_rules()])).alias("c")).collect()))
    once = found()
    monkeypatch.setattr(spans, "PREFILTERS", False)
    assert once == found() and len(once) > 10
