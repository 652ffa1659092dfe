"""Queries on JSON bodies, gates, audit, subscriptions, named entities and streams, with their SQL."""

from __future__ import annotations

import gzip
import hashlib
import hmac
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fn
from ..operators import audit, dictionary, jsonprompt, ner, requests
from ..operators.engine import PiiEngine
from ..scratch import scratch_path, stored
from ..sources.rules import secret_keywords
from ..sources import log_files, logs
from ..streaming import events as sse, live_dictionary as live, restorer, websocket
from . import sql
from .detection import ENGINE, HITS, KEY, KEYWORDS, dealt, document_mapping, literal_rows, query, table

PROMPTED = PiiEngine(KEY, [], KEYWORDS[:2], overlap="greedy")
TURNS = "(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def keyword_replaced(column: str) -> str:
    for word, category in KEYWORDS[:2]:
        column = f"replace({column}, {sql.text(word)}, {sql.placeholder(KEY, sql.text(category), sql.text(word))})"
    return column


@query(f"SELECT conv_id, list_reduce(list(content ORDER BY turn), lambda a, b: a || chr(10) || b) AS contents, sum(n)::BIGINT AS n_hits FROM (SELECT conv_id, turn, {keyword_replaced('text')} AS content, (len(string_split(text, 'ththre')) + len(string_split(text, 'cióntall')) - 2) AS n FROM {TURNS}) GROUP BY conv_id")
def redact_json_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    bodies = rows.select("conv_id", F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("body"))
    out = jsonprompt.redact_json(PROMPTED, bodies, "body")
    read = F.from_json("redacted_body", "messages array<struct<role:string,content:string>>")
    return out.select("conv_id", F.array_join(F.transform(read["messages"], lambda x: x["content"]), "\n").alias("contents"), "n_hits")


ALICE = PiiEngine(KEY, [], [("Alice", "NAME")])
TOKEN = f"__VG_NAME_{hmac.new(KEY, b'Alice', hashlib.sha256).hexdigest()[:12]}__"
BODIES = [
    '{"type":"response.create","metadata":{"note":"Alice"},"input":[{"role":"user","content":[{"type":"input_text","text":"hello Alice"}]}]}',
    '{"messages":"Alice","n":12345678901234567890.10,"z":"<&>"}', '{"a":{"contents":[{"parts":[{"text":"Alice"},"Alice",{"inlineData":"Alice"}]}]}}', '{"messages":[{"content":[{"text":"<system-reminder>Alice</system-reminder>"}]}]}',
    '{"messages":[]} Alice', 'plain Alice text', '{"input": {"text": "Alice", "messages": ["Alice"]}}', '{"system":"Alice"}', '{"messages":[{"content":{"text":"Alice"},"text":"Alice","name":"Alice"}],"b":1,"a":true}',
]
REDACTED = [
    '{"input":[{"content":[{"text":"hello @","type":"input_text"}],"role":"user"}],"metadata":{"note":"Alice"},"type":"response.create"}', '{"messages":"@","n":12345678901234567890.10,"z":"\\u003c\\u0026\\u003e"}',
    '{"a":{"contents":[{"parts":[{"text":"@"},"@",{"inlineData":"Alice"}]}]}}', BODIES[3], '{"messages":[]} @', 'plain @ text', '{"input":{"messages":["@"],"text":"Alice"}}', BODIES[7], '{"a":true,"b":1,"messages":[{"content":{"text":"@"},"name":"Alice","text":"@"}]}',
]


@query(sql.expected([(i, r.replace("@", TOKEN), r.count("@"), i not in (4, 5)) for i, r in enumerate(REDACTED)], "id int, redacted_body string, n_hits long, is_json boolean", len(REDACTED)))
def redact_json_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonprompt.redact_json(ALICE, dealt(spark, sf_dir, list(enumerate(BODIES)), "id int, body string"), "body").select("row_id", "id", "redacted_body", "n_hits", "is_json")


BODY = b'{"messages":"hi"}'
JSON = "application/json"
REQUESTS = [  # id, host, method, content_type, content_encoding, connection, upgrade, extensions, body, declared_len, read_failed; note
    (1, "a.com:443", "POST", JSON, None, None, None, None, BODY, 17, False, ""), (2, "other.com", "POST", JSON, None, None, None, None, BODY, 17, False, "pass_through"),
    (3, "a.com", "GET", None, None, "keep-alive, Upgrade", "websocket", "permessage-deflate; x, x-test", None, None, False, "websocket_upgrade_strip_permessage_deflate"), (4, "a.com", "GET", None, None, "upgrade", "WebSocket", None, None, None, False, "websocket_upgrade"),
    (5, "A.com", "GET", JSON, None, None, None, None, None, None, False, "no_body"), (6, "a.com", "POST", "image/png", None, None, None, None, BODY, 17, False, "not_text"), (7, "a.com", "POST", "Application/JSON", None, None, None, None, BODY, 17, False, "not_text"),
    (8, "a.com", "POST", JSON, "compress", None, None, None, BODY, 17, False, "encoded"), (9, "a.com", "POST", JSON, None, None, None, None, BODY, 20 << 20, False, "too_large"), (10, "a.com", "POST", JSON, "gzip", None, None, None, BODY, 17, False, "decode_error"),
    (11, "a.com", "POST", JSON, "GZIP; q=1", None, None, None, gzip.compress(BODY), 37, False, ""), (12, "a.com", "POST", "text/plain", None, None, None, None, b"\xff\xfe", 2, False, "not_utf8"), (13, "a.com", "POST", "application/x-www-form-urlencoded", None, None, None, None, b"a=b", 3, False, ""),
    (14, "a.com", "POST", JSON, None, None, None, None, BODY, 17, True, "read_error"),
]
REQUEST_SCHEMA = "id long, host string, method string, content_type string, content_encoding string, connection string, upgrade string, extensions string, body binary, declared_len long, read_failed boolean"


@query(sql.expected([(r[0], r[-1], r[-1] == "") for r in REQUESTS], "id long, note string, attempted boolean", len(REQUESTS), 1))
def gate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.gate(dealt(spark, sf_dir, [r[:-1] for r in REQUESTS], REQUEST_SCHEMA), "targets", ["a.com"]).select("row_id", "id", "note", "attempted")


RESPONSES = [(1, 101, None, True, False, 0, b"", "websocket"), (2, 200, "text/event-stream; charset=x", True, False, -1, b"", "events"), (3, 200, None, True, False, -1, b"  data: x", "events"), (4, 200, "application/vnd.x+json", False, False, 20 << 20, b"", "pass"), (5, 200, "text/json", False, False, 10, b"", "whole"), (6, 200, JSON, False, False, -1, b"", "stream"), (7, 200, "text/html", False, False, 5, b"", "stream"), (8, 200, "", True, False, 5, b"abc", "stream"), (9, 200, "", True, True, 5, b"abc", "pass"), (10, 200, "image/png", True, False, 5, b"", "pass")]


@query(sql.expected([(r[0], r[-1]) for r in RESPONSES], "id long, route string", len(RESPONSES), 1))
def response_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, [r[:-1] for r in RESPONSES], "id long, status int, content_type string, redacted boolean, encoded boolean, declared_len long, body binary")
    return rows.select("row_id", "id", requests.response_route(rows).alias("route"))


def raw_deflate(b: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(b) + c.flush()


def frame(b: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as s:
        s.write(b)
    return out.getvalue().to_pybytes()


ENCODED = [(0, "", BODY), (1, "gzip", gzip.compress(BODY)), (2, "deflate", zlib.compress(BODY)), (3, "deflate", raw_deflate(BODY)), (4, "br", pa.compress(BODY, codec="brotli", asbytes=True)), (5, "zstd", frame(BODY)), (6, "gzip, deflate", zlib.compress(gzip.compress(BODY))), (7, "identity, gzip", gzip.compress(BODY) + gzip.compress(b"x")), (8, "gzip", gzip.compress(BODY)[:-4]), (9, "zstd", b"nothing")]
DECODED = [BODY.decode()] * 7 + [BODY.decode() + "x", None, None]


@query(sql.expected([(i, d) for i, d in enumerate(DECODED)], "id int, decoded string", len(DECODED)))
def decode_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, ENCODED, "id int, content_encoding string, body binary")
    return rows.select("row_id", "id", requests.decode_body(F.col("body"), requests.encodings(F.col("content_encoding"))).cast("string").alias("decoded"))


EXTENSIONS = [(0, "permessage-deflate; client_max_window_bits, x-test", "x-test"), (1, "permessage-deflate; server_no_context_takeover", None), (2, "a, b; q", "a, b; q"), (3, None, None)]


@query(sql.expected([(i, e) for i, _, e in EXTENSIONS], "id int, kept string", len(EXTENSIONS)))
def strip_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, [x[:2] for x in EXTENSIONS], "id int, header string").select("row_id", "id", requests.without_deflate(F.col("header")).alias("kept"))


AUDITED = """(SELECT event_id AS id, ts AS time, CASE WHEN event_id % 7 = 0 THEN 'CONNECT' ELSE 'POST' END AS method, event_id % 3 <> 0 AS attempted, event_id % 5 AS redacted_count,
  CASE WHEN event_id % 11 = 0 THEN 'decode_error' WHEN event_id % 13 = 0 THEN 'invalid_json' ELSE '' END AS note, event_id % 4 = 0 AS restore_applied, event_type FROM events)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events made from the event table."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("id"), F.col("ts").alias("time"), F.when(i % 7 == 0, "CONNECT").otherwise("POST").alias("method"), (i % 3 != 0).alias("attempted"), (i % 5).alias("redacted_count"),
                                               F.when(i % 11 == 0, "decode_error").when(i % 13 == 0, "invalid_json").otherwise("").alias("note"), (i % 4 == 0).alias("restore_applied"), "event_type")


@query(f"SELECT id, method, note FROM {AUDITED} ORDER BY id DESC LIMIT 200")
def audit_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.last(audited(spark, sf_dir)).select("id", "method", "note")


@query(f"SELECT coalesce(max(id), 0) AS max_id FROM {AUDITED}")
def audit_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.next_id(audited(spark, sf_dir))


@query(f"SELECT id, event_type FROM {AUDITED} WHERE time >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def audit_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir)
    newest = rows.agg(F.max("time")).first()[0]
    return audit.purge(rows, F.lit(newest), 7 * 86400).select("id", "event_type")


@query(f"""SELECT count(*) FILTER (method <> 'CONNECT')::BIGINT AS total_requests, count(*) FILTER (attempted AND redacted_count > 0 AND note <> 'invalid_json')::BIGINT AS redacted_requests,
  count(*) FILTER (restore_applied)::BIGINT AS restored_requests, count(*) FILTER (note IN ('read_error', 'decode_error'))::BIGINT AS errors, 0::BIGINT AS restored_count FROM {AUDITED}""")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stats(audited(spark, sf_dir))


@query(f"SELECT id, note, restore_applied FROM {AUDITED} WHERE id % 10 <> 0 UNION ALL SELECT id, 'updated', true FROM {AUDITED} WHERE id % 10 = 0")
def audit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("id", "note", "restore_applied").withColumn("version", F.lit(1))
    new = rows.filter("id % 10 = 0").select("id", F.lit("updated").alias("note"), F.lit(True).alias("restore_applied"), F.lit(2).alias("version"))
    return audit.upsert(rows, new).drop("version")


SHOWN = f"""SELECT id, n, category, CASE WHEN length(original) <= 4 THEN repeat('*', length(original)) ELSE left(original, 2) || '…' || right(original, 2) END AS value, length(original)::INTEGER AS length FROM (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY start_)::INTEGER AS n, category, original FROM ({HITS})) WHERE n <= 50"""


@query(SHOWN)
def audit_match_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ENGINE.detect(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    shown = rows.select("id", F.posexplode_outer(audit.shown_matches(F.col("hits"))).alias("pos", "m")).filter("m is not null")
    return shown.select("id", (F.col("pos") + 1).alias("n"), "m.category", "m.value", "m.length")


@query(f"SELECT id, id % 2 = 0 AS has_request, id % 3 = 0 AS has_response, (id % 2 = 0 AND strlen(event_type) > 4) OR (id % 3 = 0 AND strlen(note) > 4) AS truncated FROM {AUDITED} WHERE id % 2 = 0 OR id % 3 = 0 ORDER BY id DESC LIMIT 50")
def debug_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def captured(rows: DataFrame, column: str) -> DataFrame:
        body, _, cut = fn.clip_body(F.col(column).cast("binary"), 4)
        return rows.select("id", body.alias("body"), cut.alias("truncated"))

    rows = audited(spark, sf_dir)
    return audit.merge_debug(captured(rows.filter("id % 2 = 0"), "event_type"), captured(rows.filter("id % 3 = 0"), "note"))


HEADERS = [(1, {"Authorization": ["Bearer x"], "accept": ["a", "b"]}), (2, {"x-api-key": ["k"], "My-Token": ["abc"]}), (3, {"X-NotSecret": ["s"], "Cookie": [""]}), (4, {"set-cookie": ["a=b"], "Set-Cookie": ["c d"]}), (5, {"X-Client-Secrets": ["averyveryverylongscheme x"]}),
           (6, {"OpenAI-Api-Key": ["sk-1"], "X-OpenAI-Api-Key": ["sk-2"], "anthropic-api-key": ["k"], "X-Anthropic-Api-Key": ["Key k"]}), (7, {"Proxy-Authorization": ["Basic x"], "API-Key": ["k"], "X-Goog-Api-Key": [" "], "X-Auth-Key": ["shown"]})]
MASKED = [(1, "Accept", "a,b"), (1, "Authorization", "Bearer ***"), (2, "My-Token", "***"), (2, "X-Api-Key", "***"), (3, "Cookie", ""), (3, "X-Notsecret", "s"), (4, "Set-Cookie", "***,c ***"), (5, "X-Client-Secrets", "***"), (6, "Openai-Api-Key", "***"), (6, "X-Openai-Api-Key", "***"), (6, "Anthropic-Api-Key", "***"), (6, "X-Anthropic-Api-Key", "Key ***"),
          (7, "Proxy-Authorization", "Basic ***"), (7, "Api-Key", "***"), (7, "X-Goog-Api-Key", ""), (7, "X-Auth-Key", "shown")]


@query(sql.expected(MASKED, "id int, name string, value string", len(HEADERS), 1))
def mask_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, HEADERS, "id int, headers map<string,array<string>>").select("row_id", "id", fn.mask_headers(F.col("headers")).alias("m"))
    return rows.select("row_id", "id", F.explode("m").alias("name", "v")).select("row_id", "id", "name", F.array_join(F.array_sort("v"), ",").alias("value"))


NOW = 1_000_000
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
META = [("a", "u", "e1", NOW - 90_000, 5, SHA("old"), None, "24h"), ("b", "u", "e1", NOW - 100, 5, SHA("old"), None, "24h"), ("c", "u", "e1", NOW - 90_000, 5, SHA("old"), None, None), ("d", "u", "e1", NOW - 90_000, 5, SHA("old"), None, "1m"), ("e", "u", "e1", NOW - 90_000, 5, SHA("old"), None, "24h"), ("f", "u", "e1", NOW - 50, 5, SHA("old"), None, "24h"), ("g", "u", "e1", NOW - 700, 5, SHA("old"), "x", "bad")]
FETCHED = [("a", "u", 200, "new", "e2", True), ("b", "u", 200, "new", "e2", True), ("c", "u", 304, None, None, None), ("d", "u", 200, "broken", "e2", False), ("e", "u", 200, "old", "e2", True), ("f", "v", 200, "old", "e2", True), ("g", "u", 500, None, None, None)]
AFTER = [("a", "u", "e2", NOW, NOW, SHA("new"), None, True), ("b", "u", "e1", NOW - 100, 5, SHA("old"), None, False), ("c", "u", "e1", NOW, 5, SHA("old"), None, False), ("d", "u", "e1", NOW, 5, SHA("old"), "parse error", False), ("e", "u", "e2", NOW, 5, SHA("old"), None, False), ("f", "v", "e2", NOW, NOW, SHA("old"), None, True), ("g", "u", "e1", NOW - 700, 5, SHA("old"), "x", False)]


@query("SELECT key || '-' || row_id AS key, * EXCLUDE (key, row_id, id) FROM (" + sql.expected([(i, *r) for i, r in enumerate(AFTER)], "id int, key string, url string, etag string, checked_at long, updated_at long, content_sha256 string, last_error string, changed boolean", len(AFTER)) + ")")
def subscription_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda rows: rows.withColumn("key", F.concat_ws("-", "key", "row_id")).drop("row_id")
    meta = own(dealt(spark, sf_dir, META, "key string, url string, etag string, checked_at long, updated_at long, content_sha256 string, last_error string, update_interval string"))
    return audit.merge_subscriptions(meta, own(dealt(spark, sf_dir, FETCHED, "key string, new_url string, status int, body string, new_etag string, parses boolean")), NOW)


@query("SELECT key || '-' || row_id AS key, upper(key) AS name, 'subscription' AS kind, last_error IS NULL AS verified FROM (" + sql.dealt(sql.numbered([(m[0], m[6]) for m in META]), "case_ int, key string, last_error string") + ") UNION ALL SELECT 'z-' || event_id, 'Z', 'local', false FROM events")
def rule_list_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each event, one of them local, beside what is known of subscriptions."""
    own = lambda rows: rows.withColumn("key", F.concat_ws("-", "key", "row_id"))
    meta = own(dealt(spark, sf_dir, META, "key string, url string, etag string, checked_at long, updated_at long, content_sha256 string, last_error string, update_interval string"))
    lists = meta.select("key", F.upper(F.substring("key", 1, 1)).alias("name"), F.lit(True).alias("is_subscription"))
    local = own(dealt(spark, sf_dir, [("z",)], "key string")).select("key", F.lit("Z").alias("name"), F.lit(False).alias("is_subscription"))
    return audit.rule_list_status(lists.unionByName(local), meta.drop("row_id"))


SECRET_LINES = ["# comment @", "DB_PASSWORD@=hunter2hunter@", "export TOKEN='quoted value # kept @'", "SHORT=abc", "KEY = spaced_value_@ # note", "no equals sign here @", "", '  Q="double quoted @"']
SECRETS = ["hunter2hunter@", "quoted value # kept @", "spaced_value_@", "double quoted @"]


@query("SELECT replace(pattern, '@', row_id::VARCHAR) AS pattern, 'DOTENV' AS category FROM (" + sql.dealt([(k, v) for k, v in zip((1, 2, 4, 7), SECRETS)], "case_ int, pattern string", cases=len(SECRET_LINES)) + ")")
def secret_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a secret file of as many lines as there are events."""
    lines = dealt(spark, sf_dir, [(x,) for x in SECRET_LINES], "line string")
    return secret_keywords(lines.select(F.expr("replace(line, '@', CAST(row_id AS STRING))").alias("value")), "dotenv")


PLACES = {"Rome": "GPE", "New York": "LOC", "Acme": "ORGANIZATION", "Alice": "PERSON", "Monday": "DATE"}
NER_TEXTS = [(0, "é Alice flew to New York"), (1, "Acme of Rome, on Monday"), (2, ""), (3, "none")]


@query(sql.expected([(0, 3, 8, "PERSON", "Alice"), (0, 17, 25, "LOCATION", "New York"), (1, 0, 4, "ORG", "Acme"), (1, 8, 12, "LOCATION", "Rome")], "id int, start_ int, end_ int, category string, original string", 4))
def ner_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, NER_TEXTS, "id int, text string").withColumn("found", ner.gazetteer(PLACES)(F.col("text")))
    hits = rows.select("row_id", "id", F.explode(ner.candidates(F.col("text"), F.col("found"))).alias("c"))
    return hits.select("row_id", "id", F.col("c.start").alias("start_"), F.col("c.end").alias("end_"), "c.category", "c.original")


@query(f"SELECT {sql.placeholder(KEY)} AS placeholder, original FROM (SELECT original, first(category ORDER BY id, start_ DESC) AS category, min(id) AS first_doc FROM ({HITS}) GROUP BY original) WHERE first_doc >= 4000 - 3600")
def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' mapping sealed, with entries that can't be opened or come twice, and read again."""
    mapping = document_mapping(spark, sf_dir)[1].withColumn("seq", F.unix_micros("created_at"))
    log = dictionary.seal_log(mapping, KEY)
    again = dictionary.seal_log(mapping.withColumns({"seq": F.col("seq") + 1, "placeholder": F.lit("later")}), KEY)
    broken = log.withColumn("entry", F.substring("entry", 2, 40))
    return dictionary.restore_log(log.unionByName(again).unionByName(broken), KEY, F.timestamp_seconds(F.lit(4000)), 3600).select("placeholder", "original")


@query(f"SELECT {sql.placeholder(KEY)} AS placeholder, original FROM (SELECT original, first(category ORDER BY id, start_ DESC) AS category, min(id) AS first_doc FROM ({HITS}) GROUP BY original) WHERE first_doc >= 4000 - 3600")
def session_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' mapping in files of framed, sealed records, one batch written twice, and read again by ranges."""
    log_files.register(spark)
    path = scratch_path(spark, "wal")
    sealed = stored(dictionary.seal_log(document_mapping(spark, sf_dir)[1].withColumn("seq", F.unix_micros("created_at")), KEY), "sealed")
    for _ in range(2):
        sealed.select(F.lit("").alias("file"), "seq", "entry").write.format("session_log").option("batch", "one").option("range_bytes", "4096").mode("append").save(path)
    return dictionary.restore_log(spark.read.format("session_log").load(path), KEY, F.timestamp_seconds(F.lit(4000)), 3600).select("placeholder", "original")


STEP = 37


def redacted_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """Redacted documents of conversations' keywords, cut every STEP characters; and the mapping."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    red = PROMPTED.redact(rows).withColumn("n", F.ceil(F.length("redacted") / STEP).cast("int"))
    cut = red.select("stream_id", "redacted", "n", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("seq"))
    chunks = cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(redacted, (seq - 1) * {STEP} + 1, {STEP})").alias("fragment"), (F.col("seq") >= F.col("n")).alias("is_last"))
    known = {f"__VG_{c}_{hmac.new(KEY, t.encode(), hashlib.sha256).hexdigest()[:12]}__": t for t, c in KEYWORDS[:2]}
    return chunks, known


REDACTED_TURN = keyword_replaced("text")
STREAMED = f"""SELECT conv_id || '-' || turn AS stream_id, md5({REDACTED_TURN}) AS redacted_md5, md5(text) AS restored_md5, (len(string_split(text, 'ththre')) + len(string_split(text, 'cióntall')) - 2)::BIGINT AS n_hits FROM {TURNS}"""


def stream_digests(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests of what went in (fragments of redacted text, with their placeholders counted) and of what came out."""
    whole = lambda df, c: df.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "").alias("whole"))
    sent, got = whole(chunks, "fragment"), whole(rows, "output").withColumnRenamed("whole", "out")
    n = F.regexp_count("whole", F.lit("__VG_CODE_[0-9a-f]{12}__")).cast("long")
    return sent.join(got, "stream_id").select("stream_id", F.md5(F.col("whole").cast("binary")).alias("redacted_md5"), F.md5(F.col("out").cast("binary")).alias("restored_md5"), n.alias("n_hits"))


@query(STREAMED)
def stream_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored by a streaming query over files of fragments: the conversations as they were."""
    chunks, known = redacted_chunks(spark, sf_dir)
    source, out = scratch_path(spark, "chunks"), scratch_path(spark, "restored")
    chunks.write.parquet(source)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    q = restorer.restore_stream(stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream_digests(spark.read.schema(chunks.schema).parquet(source), spark.read.schema("stream_id string, seq long, output string").parquet(out))


@query(STREAMED)
def stream_restore_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, known = redacted_chunks(spark, sf_dir)
    chunks = stored(chunks, "chunks")
    return stream_digests(chunks, restorer.restore_batch(chunks, known))


WORD = r"\p{L}{5,}"


@query(f"SELECT conv_id || '-' || turn AS stream_id, conv_id::VARCHAR AS session_id, md5(text) AS restored_md5, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_words FROM {TURNS}")
def restore_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with every word of five letters and more replaced, restored by a stream to which mappings come too; it is stopped half way and started again."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    # words and what stands between: between[0] words[0] between[1] ...
    parts = turns.withColumns({"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "between": F.split("text", WORD, -1)})
    named = F.transform("words", lambda w: dictionary.placeholder(KEY, F.lit("WORD"), w))
    red = parts.withColumn("redacted", F.concat(F.get("between", F.lit(0)), F.array_join(F.zip_with(named, F.slice("between", 2, F.size("words")), lambda a, b: F.concat(a, b)), "")))
    red = stored(red.select("session_id", "stream_id", "words", "redacted", F.greatest(F.ceil(F.length("redacted") / STEP), F.lit(1)).cast("int").alias("n")), "redacted")
    cut = red.select("session_id", "stream_id", "redacted", "n", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    chunks = cut.select("session_id", "stream_id", F.col("k").cast("long").alias("seq"), F.expr(f"substring(redacted, (k - 1) * {STEP} + 1, {STEP})").alias("fragment"), (F.col("k") == F.col("n")).alias("is_last"), (F.col("k") * 2 <= F.col("n")).alias("early"))
    words = red.select("session_id", F.explode(F.array_distinct("words")).alias("original")).repartition("session_id").distinct().sortWithinPartitions("session_id")
    mappings = words.select("session_id", dictionary.placeholder(KEY, F.lit("WORD"), F.col("original")).alias("placeholder"), "original")
    sent, known, out, checkpoint = (scratch_path(spark, n) for n in ("chunks", "mappings", "restored", "state"))
    mappings.write.parquet(known)
    for early in (True, False):
        chunks.filter(F.col("early") == early).drop("early").write.mode("append").parquet(sent)
        streams_ = (spark.readStream.schema(mappings.schema).parquet(known), spark.readStream.schema(chunks.drop("early").schema).parquet(sent))
        with live.rocksdb(spark):
            restorer.restore_sessions(*streams_).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("session_id string, stream_id string, seq long, output string").parquet(out)
    whole = rows.groupBy("session_id", "stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "output"))), lambda x: x["output"]), "").alias("whole"))
    n = red.select("stream_id", F.size("words").cast("long").alias("n_words"))
    return whole.join(n, "stream_id").select("stream_id", "session_id", F.md5(F.col("whole").cast("binary")).alias("restored_md5"), "n_words")


def delta(text: str, nested: bool = False) -> str:
    return '{"delta":' + (f'{{"text":"{text}"}}' if nested else f'"{text}"') + ',"type":"x.delta"}'


SSE = [
    ("s1", f"event: x.delta\ndata: {delta('hi __VG_NA')}\n\nevent: x.delta\ndata: {delta('ME_0123456789ab__ and')}\n\nevent: x.completed\ndata: {{\"type\":\"x.completed\"}}\n\ndata: [DONE]\n\n"),
    ("s2", f"event: content_block_delta\r\ndata: {delta('__VG_NAME_0123456789ab_', True)}\r\n\r\nevent: content_block_delta\r\ndata: {delta('_', True)}\r\n\r\n"),
    ("s3", 'data: {"choices":[{"delta":{"content":"__VG_NAME_0123456789ab__"}}]}\n\n: note\n\n'),
]


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams, each under a name of its own for each event."""
    return dealt(spark, sf_dir, SSE, "stream_id string, body string").select(F.concat_ws("-", "stream_id", "row_id").alias("stream_id"), "body")


SSE_OUT = [
    ("s1", 0, 'event: x.delta\ndata: {"delta":"hi ","type":"x.delta"}'), ("s1", 1, 'event: x.delta\ndata: {"delta":"Alice and","type":"x.delta"}'), ("s1", 2, 'event: x.completed\ndata: {"type":"x.completed"}'), ("s1", 3, "data: [DONE]"),
    ("s2", 0, 'event: content_block_delta\ndata: {"delta":{"text":""},"type":"x.delta"}'), ("s2", 1, 'event: content_block_delta\ndata: {"delta":{"text":"Alice"},"type":"x.delta"}'), ("s3", 0, 'data: {"choices":[{"delta":{"content":"Alice"}}]}'), ("s3", 1, ": note"),
]


@query("SELECT stream_id || '-' || row_id AS stream_id, seq, event FROM (" + sql.expected([(int(s[1]) - 1, s, n, e) for s, n, e in SSE_OUT], "id int, stream_id string, seq long, event string", len(SSE)) + ")")
def sse_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.restore_events(streams(spark, sf_dir), {"__VG_NAME_0123456789ab__": "Alice"})


@query(f"""SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1)::INTEGER AS seq, trim(regexp_extract(event, '(?:^|\\n)event:([^\\r\\n]*)', 1)) AS name,
  array_to_string(list_transform(regexp_extract_all(event, '(?:^|\\n)data: ?([^\\r\\n]*)', 1), lambda x: x), chr(10)) AS data FROM (SELECT stream_id, unnest(e) AS event, generate_subscripts(e, 1) AS i FROM (SELECT stream_id, regexp_split_to_array(body, '\\r?\\n\\r?\\n') AS e FROM (SELECT stream_id || '-' || row_id AS stream_id, body FROM ({sql.dealt([(k, *x) for k, x in enumerate(SSE)], 'case_ int, stream_id string, body string', 'row_id')})))) WHERE event <> ''""")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.parsed_events(streams(spark, sf_dir)).select("stream_id", "seq", "name", "data")


FRAMES = [("c", "up", 1, True, 0, 1, "hello Alice"), ("c", "up", 2, False, 0, 1, "hel"), ("c", "up", 3, True, 0, 9, "ping"), ("c", "up", 4, False, 0, 0, "lo Al"), ("c", "up", 5, True, 0, 0, "ice"), ("c", "up", 6, True, 4, 1, "packed"), ("c", "down", 1, True, 0, 0, "orphan"), ("c", "down", 2, True, 0, 2, "binary"), ("d", "up", 1, False, 0, 1, "open")]
FRAME_SCHEMA = "conn string, dir string, seq int, fin boolean, rsv int, opcode int, payload string"


@query(f"""SELECT conn, dir, message, count(*)::BIGINT AS n_frames, string_agg(payload, '' ORDER BY seq) AS payload, message > 0 AND first(opcode ORDER BY seq) = 1 AND first(rsv ORDER BY seq) = 0 AND last(fin ORDER BY seq) AS is_text FROM (
  SELECT *, sum(CASE WHEN opcode > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conn, dir ORDER BY seq)::BIGINT AS message FROM (SELECT conn || '-' || row_id // {len(FRAMES)} AS conn, * EXCLUDE (conn, row_id) FROM ({sql.dealt(sql.numbered(FRAMES), 'case_ int, ' + FRAME_SCHEMA)})) WHERE opcode < 8) GROUP BY conn, dir, message""")
def ws_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of a few events each, a frame by event."""
    frames = dealt(spark, sf_dir, FRAMES, FRAME_SCHEMA)
    return audit.reassembled(frames.withColumn("conn", F.concat_ws("-", "conn", F.floor(F.col("row_id") / len(FRAMES)))).drop("row_id"))


@query(sql.values([("c", "up", 1, f"hello {TOKEN}", "hello Alice"), ("c", "up", 2, f"hello {TOKEN}", "hello Alice"), ("c", "up", 3, "packed", "packed"), ("c", "down", 0, "orphan", "orphan"), ("c", "down", 1, "binary", "binary"), ("d", "up", 1, "open", "open")], "conn string, dir string, message long, redacted string, restored string"))
def ws_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text messages redacted on the way up and restored on the way down."""
    rows = audit.reassembled(literal_rows(spark, FRAMES, FRAME_SCHEMA))
    red = ALICE.redact(rows, "payload").withColumn("redacted", F.when(F.col("is_text"), F.col("redacted")).otherwise(F.col("payload"))).select("conn", "dir", "message", "redacted")
    mapping = literal_rows(spark, [(TOKEN, "Alice")], "placeholder string, original string")
    return ALICE.restore(red, mapping, "redacted").select("conn", "dir", "message", "redacted", "restored")


SESSION = [("x", "px", 1000), ("y", "py", 1010), ("x", "px", 1050), ("x", "px", 1061), ("x", "px", 1100), ("y", "py", 1200)]


@query(sql.values([("x", "px", 1000), ("x", "px", 1061), ("y", "py", 1010), ("y", "py", 1200)], "original string, placeholder string, registered_at long"))
def session_ttl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = scratch_path(spark, "hits"), scratch_path(spark, "sessions")
    literal_rows(spark, SESSION, "original string, placeholder string, at long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("original string, placeholder string, at long").parquet(source)
    restorer.session_stream(stream, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("original string, placeholder string, registered_at long").parquet(out)


@query("SELECT line_no, value FROM (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, source || ' ' || lang AS value FROM documents) ORDER BY line_no DESC LIMIT 100")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of a log; line numbers come with the rows."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("seq"), F.concat_ws(" ", "source", "lang").alias("value"))
    return audit.tail(rows, 100).select(F.col("seq").alias("line_no"), "value")


@query(sql.expected([(0, "secret word"), (1, "é"), (2, "not sealed")], "id int, opened string", 3))
def sealed_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed configuration values opened again, and others as they are."""
    rows = dealt(spark, sf_dir, [(0, "secret word"), (1, "é"), (2, "")], "id int, value string").withColumn("sealed", fn.seal(F.col("value"), KEY))
    plain = F.when(F.col("id") == 2, F.lit("not sealed")).otherwise(F.col("sealed"))
    return rows.select("row_id", "id", fn.open_sealed(plain, KEY).alias("opened"))


#: Frames masked, of control, packed and cut; every fiftieth case is one of more than 65,535 bytes.
SMALL = websocket.build_frame(b"hello Alice", mask=b"\x01\x02\x03\x04") + websocket.build_frame(b"", 9) + websocket.build_frame(b"x" * 200, 0, False, 4) + b"\x81\x7f"
RAW = [(k, SMALL) for k in range(49)] + [(49, websocket.build_frame(b"y" * 70_000, 2))]
FRAMED = [(k, *f) for k in range(49) for f in ((0, True, 0, 1, 11), (1, True, 0, 9, 0), (2, False, 4, 0, 200))] + [(49, 0, True, 0, 2, 70_000)]


@query(sql.expected(FRAMED, "id int, seq int, fin boolean, rsv int, opcode int, n int", len(RAW)))
def ws_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, RAW, "id int, raw binary").select("row_id", "id", F.explode(websocket.frames_of("raw")).alias("f"))
    return rows.select("row_id", "id", "f.seq", "f.fin", "f.rsv", "f.opcode", F.octet_length("f.payload").alias("n"))


@query(sql.values([("a", "x"), ("b", "y")], "placeholder string, original string"))
def framed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log in its binary frames: sealed entries, one that can't be opened, and a cut last one."""
    mapping = literal_rows(spark, [("a", "x", 1, 5000), ("b", "y", 2, 5001), ("c", "x", 3, 5002), ("d", "z", 4, 10)], "placeholder string, original string, seq long, at long").withColumn("created_at", F.timestamp_seconds("at"))
    entries = dictionary.seal_log(mapping, KEY).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda e: e["entry"]).alias("e"))
    length = lambda e: F.unhex(F.lpad(F.hex(F.octet_length(e)), 8, "0"))
    raw = entries.select(F.aggregate("e", F.lit(b""), lambda acc, e: F.concat(acc, length(e), e)).alias("raw"))
    raw = raw.select(F.concat("raw", F.lit(b"\x00\x00\x00\x14" + b"0" * 20 + b"\x00\x00\x00\xff" + b"cut")).alias("raw"))
    log = raw.select(F.posexplode(logs.entries_of("raw")).alias("seq", "entry"))
    return dictionary.restore_log(log, KEY, F.timestamp_seconds(F.lit(6000)), 3600).select("placeholder", "original")
