"""Queries over the rule language, settings, sessions and the audit store."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fn
from ..operators import audit, dictionary, ner, requests, spans
from ..operators.audit_store import AuditStore
from ..operators.engine import PiiEngine, exploded
from ..scratch import scratch_path, stored
from ..sources import logs
from ..sources.rules import Config, Rule, RuleError, RuleList, merge_keywords, parse_rules
from ..sources.requests import read_requests
from ..sources.settings import RuleListCache, config_of, opener, secret_files
from ..streaming import live_dictionary as live
from . import sql
from .detection import ENGINE, FIRST, HITS, KEY, dealt, document_mapping, literal_rows, query, table
from .services import AUDITED, audited

LISTS = [
    ("# c\n; c\n! c\n// c\n\n  keyword my-cat John Doe \nK\tORG\tExample Corp\nRegEx  mail (?i)a@b\n", 200), ("k A x\nword B y", 10), ("regex A (?=x)", 10), ("r A (?m)^x$\nr A (?U)x+", 0), ("keyword A", 10), ("keyword -- x", 10), ("keyword A " + "x" * (1 << 20), 10), ("", -3),
]
PARSED = [(0, 0, "keyword", "MY_CAT", "John Doe", 99), (0, 1, "keyword", "ORG", "Example Corp", 99), (0, 2, "regex", "MAIL", "(?i)a@b", 99), (1, -1, None, None, None, None), (2, -1, None, None, None, None), (3, 0, "regex", "A", "(?m)^x$", 50), (3, 1, "regex", "A", "(?U)x+", 50), (4, -1, None, None, None, None), (5, -1, None, None, None, None), (6, -1, None, None, None, None)]


@query(sql.values(PARSED, "list_no int, rule_ord int, kind string, category string, pattern string, priority int"))
def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule texts as they are read; one bad line leaves nothing of a list but that it is bad (rule_ord -1)."""
    rows = []
    for n, (text, priority) in enumerate(LISTS):
        try:
            made = parse_rules(text, "x", priority)
            rows += [(n, i, r.kind, r.category, r.pattern, made.priority) for i, r in enumerate(made.rules)]
        except RuleError:
            rows.append((n, -1, None, None, None, None))
    return literal_rows(spark, rows, "list_no int, rule_ord int, kind string, category string, pattern string, priority int")


LINED = [(1, "x\nxx\nx"), (2, "x"), (3, "ax\n"), (4, None)]


@query(sql.expected([(1, 0, "A", "x"), (1, 5, "A", "x"), (2, 0, "A", "x"), (1, 0, "B", "x"), (1, 2, "B", "x"), (1, 3, "B", "x"), (1, 5, "B", "x"), (2, 0, "B", "x"), (3, 1, "B", "x")], "id int, start_ int, category string, original string", 4, 1))
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the flags m (lines) and U (least repetition first)."""
    rows = dealt(spark, sf_dir, LINED, "id int, text string").withColumn("segments", spans.safe_segments(F.col("text")))
    found = spans.detect("segments", [RuleList([Rule("regex", "A", "(?m)^x$"), Rule("regex", "B", "(?U)x+")])])
    return exploded(rows.select("row_id", "id", found.alias("found")), "found").select("row_id", "id", F.col("h.start").alias("start_"), "h.category", "h.original")


FALLBACKS = [(1, "Alpha beta"), (2, "x gamma")]


@query(sql.expected([(1, "TEXT", "Alpha"), (1, "REGEX", "beta"), (2, "REGEX", "gamma")], "id int, category string, original string", 2, 1))
def category_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords without a category are TEXT, patterns without one REGEX; a keyword with an empty one is left out of detection."""
    config = config_of({"patterns": {"keywords": [{"value": "Alpha"}], "regex": [{"pattern": "beta|gamma"}]}}, str)
    rows = PiiEngine(KEY, config.rule_lists, [*config.keywords, ("x", "")]).detect(dealt(spark, sf_dir, FALLBACKS, "id int, text string"))
    return exploded(rows.select("row_id", "id", "hits"), "hits").select("row_id", "id", "h.category", "h.original")


LANGUAGES = [(0, " EN_us "), (1, "auto"), (2, "AUTO "), (3, "zh--Hans!"), (4, "-_ x _-"), (5, "")]


@query(sql.expected([(0, "en-us"), (1, "auto"), (2, "auto"), (3, "zh-hans"), (4, "x"), (5, "")], "id int, language string", 6))
def sanitize_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, LANGUAGES, "id int, raw string").select("row_id", "id", fn.sanitize_language(F.col("raw")).alias("language"))


DURATIONS = ["24h", "7d", "1h30m", "250ms", "x", "", "-2s", "1d2h", "1.5h", " 3m "]


@query(sql.expected([(0, 86400.0), (1, 604800.0), (2, 5400.0), (3, 0.25), (4, -1.0), (5, -1.0), (6, -2.0), (7, -1.0), (8, 5400.0), (9, 180.0)], "id int, seconds double", 10))
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, list(enumerate(DURATIONS)), "id int, raw string").select("row_id", "id", fn.duration_seconds(F.col("raw"), -1).alias("seconds"))


NER_URLS = [(0, "http://h:1/analyze/?x#y"), (1, "https://h"), (2, "ftp://h"), (3, "http://h/a/"), (4, None)]


@query(sql.expected([(0, "http://h:1/analyze"), (1, "https://h/analyze"), (2, None), (3, "http://h/a/analyze"), (4, None)], "id int, url string", 5))
def ner_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, NER_URLS, "id int, raw string").select("row_id", "id", ner.analyze_url(F.col("raw")).alias("url"))


@query(sql.values([(0, "en", None), (1, "en", None), (2, "de-at", 0.5), (3, "en", 1.0)], "id int, language string, score_threshold double"))
def ner_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request to a model says beside its text."""
    asked = [ner.request_options(), ner.request_options("auto", 0.0), ner.request_options("DE_at", 0.5), ner.request_options("", 3.0)]
    return literal_rows(spark, [(i, o["language"], o.get("score_threshold")) for i, o in enumerate(asked)], "id int, language string, score_threshold double")


SECRETS = [("s", "C"), ("t", "DOTENV")]


@query(sql.values([(0, "a", "A"), (1, "s", "C"), (2, "t", "DOTENV")], "ord int, text string, category string"))
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured keywords come before secrets, and each text once; of an engine's keywords with one text the last counts."""
    merged = merge_keywords([("a", "A"), ("s", "C")], [("s", "DOTENV"), ("t", "DOTENV")])
    engine = PiiEngine(KEY, [], [*merged[:1], ("s", "X"), *merged[1:]])
    return literal_rows(spark, [(i, t, c) for i, (t, c) in enumerate(engine.keywords)], "ord int, text string, category string")


def derived(use: str) -> bytes:
    return hashlib.sha256(hashlib.sha256(KEY).digest() + f"palimpsest/{use}".encode()).digest()


@query(f"""SELECT event_id, mode, CASE WHEN mode = 'fixed' THEN substr({sql.hmac(derived('placeholders'), 'event_id::VARCHAR')}, 1, 12) WHEN mode = 'other' THEN substr({sql.hmac(derived('log'), 'event_id::VARCHAR')}, 1, 12) END AS digits, mode <> 'random' AS again
  FROM events, (SELECT unnest(['fixed', 'other', 'random']) AS mode)""")
def key_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys derived from one secret give the same placeholders again, each use its own; random ones don't."""
    digits = lambda key: F.substring(dictionary.hmac_sha256(key, F.col("event_id").cast("string")), 1, 12)
    keys = [("fixed", dictionary.derived_key(KEY, "placeholders"), dictionary.derived_key(KEY, "placeholders")), ("other", dictionary.derived_key(KEY, "log"), dictionary.derived_key(KEY, "log")), ("random", dictionary.random_key(), dictionary.random_key())]
    modes = [F.struct(F.lit(mode).alias("mode"), (digits(one) if mode != "random" else F.lit(None).cast("string")).alias("digits"), (digits(one) == digits(two)).alias("again")) for mode, one, two in keys]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(F.array(*modes)).alias("x")).select("event_id", "x.*")


GLOBAL = {"proxy": {"placeholder_prefix": "__P_", "intercept_mode": "targets"}, "targets": [{"host": " A.com ", "enabled": True}, {"host": "b.com"}], "session": {"ttl": "2h", "max_mappings": 5, "wal_enabled": False},
          "patterns": {"keywords": [{"value": " al​pha ", "category": "my cat"}, {"value": " "}], "exclude": ["x", ""], "builtin": ["email", "none"], "rule_lists": [{"id": "one", "path": "p", "enabled": True, "priority": 500}, {"id": "one", "path": "q", "enabled": True}, {"path": "q", "enabled": True}, {"path": "off"}],
                       "ner": {"enabled": False, "min_score": 7}, "secret_files": [{"path": ".env"}, {"path": ".env", "format": "DOTENV"}, {"path": "s", "format": "lines", "min_value_len": 5000}, {"path": "off", "enabled": False}]}}
PROJECT = {"session": {"wal_enabled": True, "deterministic_placeholders": True}, "patterns": {"keywords": [{"value": "beta"}], "ner": {"enabled": True, "entities": ["ORG"]}}}
RULE_FILES = {"p": "k A a", "q": "k B b"}


@query(sql.values([("keywords", "alpha:MY_CAT,beta:TEXT"), ("excludes", "x"), ("rule_lists", "patterns:50:1,one:99:1,q:50:1"), ("targets", "a.com"), ("ner", "True:ORG:1.0"), ("mode", "targets"), ("wal", "False:False"), ("prefix", "__P_"), ("ttl", "7200"), ("max_mappings", "5"), ("secret_files", "dotenv:.env:DOTENV:8,lines:s:SECRET_FILE:1024")], "name string, value string"))
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a global and a project's tree, cleaned and laid over each other."""
    c = config_of(GLOBAL, RULE_FILES.__getitem__).merge(config_of(PROJECT, RULE_FILES.__getitem__, project=True))
    rows = [("keywords", ",".join(f"{t}:{k}" for t, k in c.keywords)), ("excludes", ",".join(c.excludes)), ("rule_lists", ",".join(f"{r.name}:{r.priority}:{len(r.rules)}" for r in c.rule_lists)), ("targets", ",".join(c.targets)), ("ner", f"{c.ner_enabled}:{','.join(c.ner_entities)}:{c.ner_min_score}"),
            ("mode", c.intercept_mode), ("wal", f"{c.wal}:{c.deterministic}"), ("prefix", c.prefix), ("ttl", str(int(c.ttl_seconds))), ("max_mappings", str(c.max_mappings)), ("secret_files", ",".join(f"{s['format']}:{s['path']}:{s['category']}:{s['min_value_len']}" for s in secret_files(GLOBAL)))]
    return literal_rows(spark, rows, "name string, value string")


@query(sql.values([(0, "d:X", ""), (1, "d:X", "mine:1"), (2, "d:X", "mine:1"), (3, "d:X", "")], "step int, keywords string, rule_lists string"))
def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords added, changed and deleted; a rule list added, refused and deleted."""
    c, rows = Config(), []
    say = lambda: rows.append((len(rows), ",".join(f"{t}:{k}" for t, k in c.keywords), ",".join(f"{r.name}:{len(r.rules)}" for r in c.rule_lists)))
    c.add_keyword(" a​b ", "my cat")
    c.add_keyword("c")
    c.update_keyword(1, "d", "x")
    c.delete_keyword(0)
    say()
    c.add_rule_list("k A word", "mine")
    say()
    try:
        c.add_rule_list("bad", "mine")
    except RuleError:
        say()
    c.delete_rule_list("mine")
    say()
    return literal_rows(spark, rows, "step int, keywords string, rule_lists string")


@query(sql.values([(0, "a:A,b:B", ""), (1, "a:A,b:C", "a"), (2, "a:A", ""), (3, "", "")], "round int, rules string, errors string"))
def hot_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in which rule lists changed: one call each; what doesn't parse leaves the old list; equal contents call nobody."""
    calls, errors = [], []
    cache = RuleListCache(lambda active: calls.append(",".join(f"{k}:{r.category}" for k, lst in sorted(active.items()) for r in lst.rules)))
    for contents in ({"a": "k A x", "b": "k B x"}, {"a": "k A x", "b": "k B x"}, {"a": "bad", "b": "k C x"}):
        failed = cache.refresh(contents)
        if len(errors) < len(calls):
            errors.append(",".join(failed))
    cache.toggle("b", False)
    cache.delete("a")
    errors += [""] * (len(calls) - len(errors))
    return literal_rows(spark, [(i, c, e) for i, (c, e) in enumerate(zip(calls, errors))], "round int, rules string, errors string")


@query(f"""WITH f AS (SELECT {sql.placeholder(KEY)} AS placeholder, original, category FROM ({FIRST}))
  SELECT 'lookup' AS asked, placeholder AS a, original AS b FROM f WHERE category = 'EMAIL' UNION ALL SELECT 'reverse', placeholder, original FROM f WHERE category = 'IPV4'
  UNION ALL SELECT 'size', count(*)::VARCHAR, '10' FROM f UNION ALL SELECT 'cleared', '0', '10'""")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' session asked for placeholders, for originals, for its size, and after it was cleared."""
    mapping = document_mapping(spark, sf_dir)[1]
    of = lambda category, column: mapping.filter(F.col("category") == category).select(column).unionByName(literal_rows(spark, [("none",), (None,)], f"{column} string"))
    found = dictionary.lookup(mapping, of("EMAIL", "placeholder")).select(F.lit("lookup").alias("asked"), F.col("placeholder").alias("a"), F.col("original").alias("b"))
    back = dictionary.reverse(mapping, of("IPV4", "original")).select(F.lit("reverse").alias("asked"), F.col("placeholder").alias("a"), F.col("original").alias("b"))
    size = lambda m, name: dictionary.gauges(m, 10, 60).select(F.lit(name).alias("asked"), F.col("active").cast("string").alias("a"), F.col("most").cast("string").alias("b"))
    return found.unionByName(back).unionByName(size(mapping, "size")).unionByName(size(dictionary.cleared(mapping), "cleared"))


NEWEST = "(SELECT max(ts) FROM events) - INTERVAL 7 DAY"


@query(f"""SELECT id AS event_id, method, CASE WHEN note = 'decode_error' THEN 'seen' ELSE note END AS note, redacted_count::BIGINT AS redacted_count FROM {AUDITED} WHERE time >= {NEWEST}""")
def audit_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store cleared of what it held, fed by a stream, updated by id and purged."""
    rows = audited(spark, sf_dir).select("time", "method", "note", "redacted_count", "attempted", "restore_applied", F.col("id").cast("string").alias("path"))
    source = scratch_path(spark, "events")
    rows.write.parquet(source)
    store = AuditStore(spark, scratch_path(spark, "store"))
    store.insert(rows.limit(10))
    store.clear()
    store.feed(spark.readStream.schema(rows.schema).parquet(source), scratch_path(spark, "state")).awaitTermination()
    store.update(store.read().filter("note = 'decode_error'").withColumn("note", F.lit("seen")))
    store.purge(F.lit(rows.agg(F.max("time")).first()[0]), 7 * 86400)
    kept = store.read()
    assert kept.agg(F.countDistinct("id") == F.count(F.lit(1))).first()[0]
    return kept.select(F.col("path").cast("long").alias("event_id"), "method", "note", "redacted_count")


@query(f"SELECT count(*) FILTER (method <> 'CONNECT')::BIGINT AS total_requests, count(*) FILTER (restore_applied)::BIGINT AS restored_requests, count(*) FILTER (note IN ('read_error', 'decode_error'))::BIGINT AS errors FROM {AUDITED}")
def audit_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that a stream of events keeps up to date: those after its last batch."""
    rows = stored(audited(spark, sf_dir), "events")
    stream, out = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(rows.inputFiles()[0].rsplit("/", 1)[0]), scratch_path(spark, "stats")
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    audit.stats(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).orderBy(F.col("batch").desc()).limit(1).select("total_requests", "restored_requests", "errors")


@query("SELECT coalesce(source, '-') || ' ' || coalesce(lang, '-') || ' ' || doc_id AS value FROM documents ORDER BY doc_id DESC LIMIT 100")
def log_file_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of a log in several files."""
    path = scratch_path(spark, "log")
    table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.concat_ws(" ", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), "doc_id").alias("value")).write.text(path)
    return logs.tail_file(spark, path, 100)


SENT = [(-1, "a.com", "application/json", b"{}"), (-2, "a.com", "application/json", b"x" * ((10 << 20) + 9)), (-3, "a.com", "image/png", b"x"), (-4, "a.com", None, None)]


@query(sql.values([(-1, 2, ""), (-2, (10 << 20) + 1, "too_large"), (-3, 1, "not_text"), (-4, None, "no_body")], "id long, n int, note string") + " UNION ALL SELECT doc_id, strlen(text)::INTEGER, CASE WHEN coalesce(text, '') = '' THEN 'no_body' ELSE '' END FROM documents")
def request_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests read from files, documents as their bodies; those too large are cut where the gate says so."""
    path = scratch_path(spark, "requests")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("a.com").alias("host"), F.lit("text/plain").alias("content_type"), F.encode("text", "UTF-8").alias("body"))
    docs.unionByName(literal_rows(spark, SENT, "id long, host string, content_type string, body binary")).write.parquet(path)
    return requests.gate(read_requests(spark, path)).select("id", F.octet_length("body").alias("n"), "note")


CAPTURED = [(1, "ab", False), (2, "cd", True)]


@query(sql.values([(2, "cd", True, None), (1, "ab", False, "xy")], "id long, request string, cut boolean, response string"))
def debug_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by id, with the bounds of what they keep."""
    assert [audit.body_cap(n) for n in (0, 1, 1 << 20, 1 << 30)] == [1 << 20, 4 << 10, 1 << 20, 20 << 20]
    sent, got = literal_rows(spark, CAPTURED, "id long, body string, truncated boolean"), literal_rows(spark, [(1, "xy", False)], "id long, body string, truncated boolean")
    out = audit.get_debug(sent, got, 2).unionByName(audit.get_debug(sent, got, 1))
    return out.select("id", F.col("request.body").alias("request"), F.col("request.truncated").alias("cut"), F.col("response.body").alias("response"))


@query(f"SELECT method, count(*)::BIGINT AS n, count(*)::BIGINT AS n_ids FROM {AUDITED} GROUP BY method")
def audit_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store held and what came after, as a stream tells it: half of the events, then the others."""
    store, out, state = AuditStore(spark, scratch_path(spark, "store")), scratch_path(spark, "followed"), scratch_path(spark, "state")
    run = lambda: store.follow().select("id", "method").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = audited(spark, sf_dir).withColumnRenamed("id", "event")
    for half in (0, 1):
        store.insert(rows.filter(F.col("event") % 2 == half))
        run()
    return spark.read.schema("id long, method string").parquet(out).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query(sql.values([("open", "C"), ("plain", "TEXT")], "text string, category string"))
def sealed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of settings, sealed ones opened and those that can't be left out."""
    sealed = spark.range(1).select(fn.seal(F.lit("open"), KEY)).first()[0]
    tree = {"patterns": {"keywords": [{"value": sealed, "category": "c"}, {"value": "plain"}, {"value": "__VG_ENC_V1__:AAAA"}]}}
    return literal_rows(spark, config_of(tree, str, opener(spark, KEY)).keywords, "text string, category string")


LIVE_SQL = f"SELECT coalesce(source, '') AS session_id, original, first(category ORDER BY id, start_ DESC) AS category, min(id) AS created_at FROM ({HITS}) JOIN (SELECT doc_id AS id, source FROM documents) USING (id) GROUP BY ALL"


@query(f"SELECT session_id, original, category, {sql.placeholder(KEY)} AS placeholder, created_at FROM ({LIVE_SQL})")
def live_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' dictionaries (a source is a session) from streamed hits of documents; the query is stopped half way and started again on its checkpoint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("session_id"), "text")
    hits = exploded(ENGINE.detect(docs).select("doc_id", "session_id", "hits"), "hits").select("session_id", F.col("doc_id").alias("doc_ord"), "h.start", "h.category", "h.original", F.col("doc_id").alias("at"))
    hits = stored(hits, "hits")
    middle = hits.agg(F.percentile_approx("doc_ord", 0.5).alias("m")).first().m or 0
    source, out, checkpoint = (scratch_path(spark, n) for n in ("hits", "events", "state"))
    for part in (F.col("doc_ord") <= middle, F.col("doc_ord") > middle):
        hits.filter(part).coalesce(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema(hits.schema).parquet(source)
        with live.rocksdb(spark):
            live.dictionary_stream(stream, KEY).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return live.standing(spark.read.schema(live.EVENTS).parquet(out))
