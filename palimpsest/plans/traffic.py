"""Queries over rows with odd ids, whole requests, WebSocket messages, recognizers and event streams."""

from __future__ import annotations

import gzip
import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, jsonprompt, ner, restore as restoring, spans, traffic
from ..operators.engine import PiiEngine, exploded
from ..scratch import scratch_path
from ..sources.rules import Rule, RuleList
from ..streaming import events as sse, restorer, websocket
from . import sql
from .detection import KEY, dealt, literal_rows, query, table
from .services import ALICE, BODY, FRAME_SCHEMA, JSON, PLACES, REQUEST_SCHEMA, SSE, SSE_OUT, TOKEN

PEOPLE = PiiEngine(KEY, [], [("Alice", "NAME"), ("Bob", "NAME")])


def token(name: str, category: str = "NAME") -> str:
    return f"__VG_{category}_{hmac.new(KEY, name.encode(), hashlib.sha256).hexdigest()[:12]}__"


ODD_IDS = [(1, "x Bob"), (1, "hi Alice, Bob"), (1, "hi Alice, Bob"), (None, "hi Alice"), (None, None), (2, ""), (2, "none"), (None, "é Bob é")]
ODD_SQL = sql.dealt(sql.numbered(ODD_IDS), "case_ int, doc_id long, text string")
PEOPLE_REPLACED = f"replace(replace(text, 'Alice', '{token('Alice')}'), 'Bob', '{token('Bob')}')"
PEOPLE_COUNT = "coalesce(len(string_split(text, 'Alice')) + len(string_split(text, 'Bob')) - 2, 0)::BIGINT"


@query(f"SELECT row_id, doc_id, {PEOPLE_REPLACED} AS redacted, {PEOPLE_COUNT} AS n_hits FROM ({ODD_SQL})")
def redact_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one id, with none, and alike: each has its own hits."""
    out, _ = PEOPLE.redact_with_mapping(dealt(spark, sf_dir, ODD_IDS, "doc_id long, text string"), "doc_id")
    return out.select("row_id", "doc_id", "redacted", F.greatest(F.size("hits"), F.lit(0)).cast("long").alias("n_hits"))


@query(f"SELECT row_id, doc_id, {PEOPLE_REPLACED} AS redacted, text AS restored, {PEOPLE_COUNT} AS n_restored FROM ({ODD_SQL})")
def restore_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, mapping = PEOPLE.redact_with_mapping(dealt(spark, sf_dir, ODD_IDS, "doc_id long, text string"), "doc_id")
    return PEOPLE.restore(red.select("row_id", "doc_id", "redacted"), mapping, "redacted").select("row_id", "doc_id", "redacted", "restored", "n_restored")


ODD_BODIES = [(1, '{"messages":["Alice","x"]}'), (1, '{"messages":["Bob","Alice"]}'), (None, '{"input":"Alice \\u001b]0;t"}'), (None, None), (2, "not JSON, Alice"), (2, ""), (3, '{"messages":["Bo","b","Bob"],"n":1.0}'), (3, '{"messages":["Bo","b","Bob"],"n":1.0}')]


@query(f"""SELECT row_id, id, {PEOPLE_REPLACED.replace("text", "body")} AS redacted_body, {PEOPLE_COUNT.replace("text", "body")} AS n_hits, coalesce(json_valid(body), false) AS is_json FROM ({sql.dealt(sql.numbered(ODD_BODIES), 'case_ int, id long, body string')})""")
def redact_json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with one id, with none, and alike; prompts whose ends would make a hit together."""
    out = jsonprompt.redact_json(PEOPLE, dealt(spark, sf_dir, ODD_BODIES, "id long, body string"), "body")
    return out.select("row_id", "id", "redacted_body", "n_hits", "is_json")


ASKED = b'{"metadata":{"note":"Alice"},"messages":[{"role":"user","content":"hello Alice"}]}'
DONE = f'{{"messages":[{{"content":"hello {TOKEN}","role":"user"}}],"metadata":{{"note":"Alice"}}}}'
# id, content_type, content_encoding, body; note, attempted, out_body, redacted_count, redacted
TRAFFIC = [
    ((1, JSON, None, ASKED), ("", True, DONE, 1, True)), ((2, JSON + "; charset=utf-8", "gzip", gzip.compress(ASKED)), ("", True, DONE, 1, True)), ((3, JSON, None, BODY), ("", True, BODY.decode(), 0, False)),
    ((4, JSON, None, b'{"messages":"Alice" broken'), ("", True, f'{{"messages":"{TOKEN}" broken', 1, True)), ((5, "text/plain", None, ASKED), ("", True, ASKED.decode().replace("Alice", TOKEN), 2, True)),
    ((6, "text/plain", None, "é Alice".encode()), ("", True, f"é {TOKEN}", 1, True)), ((7, "image/png", None, b"Alice"), ("not_text", False, "Alice", 0, False)), ((8, JSON, "x-gzip", b"Alice"), ("encoded", False, "Alice", 0, False)),
    ((1, JSON, None, b'{"input":"Alice"}'), ("", True, f'{{"input":"{TOKEN}"}}', 1, True)), ((None, JSON, None, None), ("no_body", False, None, 0, False)), ((None, "text/plain", None, b"Alice"), ("", True, TOKEN, 1, True)),
]


def asked(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    return dealt(spark, sf_dir, [(i, "a.com", "POST", kind, encoding, None, None, None, body, len(body or b""), False) for i, kind, encoding, body in rows], REQUEST_SCHEMA)


TRAFFIC_COLUMNS = "id long, note string, attempted boolean, out_body string, redacted_count long, redacted boolean, n_matches int"


@query(sql.dealt(sql.numbered([(r[0], *out, out[3]) for r, out in TRAFFIC]), "case_ int, " + TRAFFIC_COLUMNS))
def redact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from gate to audit row: decoded, redacted in prompts or as a whole, forwarded."""
    out = traffic.redact_requests(ALICE, asked(spark, sf_dir, [r for r, _ in TRAFFIC]))
    return out.select("row_id", "id", "note", "attempted", "out_body", "redacted_count", "redacted", F.greatest(F.size("matches"), F.lit(0)).alias("n_matches"))


BREAKING = PiiEngine(KEY, [RuleList([Rule("regex", "Q", r'("n":\d)')])])
BROKEN = [(1, JSON, None, b'{"n":1}'), (2, "text/plain", None, b'{"n":1}'), (3, JSON, None, b'{"n":1')]


@query(f"""SELECT row_id, id, CASE WHEN id = 1 THEN 'invalid_json' ELSE '' END AS note, CASE WHEN id = 1 THEN body ELSE replace(body, '"n":1', '{token('"n":1', 'Q')}') END AS out_body, 1::BIGINT AS redacted_count, id > 1 AS redacted FROM ({sql.dealt(sql.numbered([(r[0], r[3].decode()) for r in BROKEN]), 'case_ int, id long, body string')})""")
def invalid_json_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that redaction as a whole breaks goes on as it came, with its hits counted."""
    return traffic.redact_requests(BREAKING, asked(spark, sf_dir, BROKEN), json_prompts=False).select("row_id", "id", "note", "out_body", "redacted_count", "redacted")


CREATE = '{"type":"response.create","metadata":{"note":"Alice"},"input":[{"role":"user","content":[{"type":"input_text","text":"hello Alice"}]}]}'
CREATED = f'{{"input":[{{"content":[{{"text":"hello {TOKEN}","type":"input_text"}}],"role":"user"}}],"metadata":{{"note":"Alice"}},"type":"response.create"}}'
JSON_FRAMES = [("c", "up", 1, False, 0, 1, CREATE[:40]), ("c", "up", 2, True, 0, 0, CREATE[40:]), ("c", "up", 3, True, 0, 1, "plain Alice"), ("c", "up", 4, True, 0, 1, '{"system":"Alice"}'), ("c", "up", 5, True, 0, 2, "Alice"), ("c", "down", 1, True, 0, 1, "Alice")]


@query(sql.values([("c", "up", 1, CREATED), ("c", "up", 2, f"plain {TOKEN}"), ("c", "up", 3, '{"system":"Alice"}'), ("c", "up", 4, "Alice"), ("c", "down", 1, "Alice")], "conn string, dir string, message long, redacted string"))
def ws_json_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on their way up: JSON in its prompts only, other text as a whole, the rest untouched."""
    return traffic.redact_messages(ALICE, audit.reassembled(literal_rows(spark, JSON_FRAMES, FRAME_SCHEMA))).select("conn", "dir", "message", "redacted")


BAD_RAW = [(0, websocket.build_frame(b"one") + b"\x81\x7f" + b"\xff" * 8 + b"rest Alice"), (None, websocket.build_frame(b"two")), (None, None)]


@query(sql.dealt([(0, 0, 0, 1, "one"), (0, 0, 1, None, "817fffffffffffffffff7265737420416c696365"), (1, None, 0, 1, "two")], "case_ int, id int, seq int, opcode int, payload string", cases=3))
def ws_bad_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After what is no frame all bytes pass on as they are."""
    rows = dealt(spark, sf_dir, BAD_RAW, "id int, raw binary").select("row_id", "id", F.explode(websocket.frames_of("raw")).alias("f"))
    return rows.select("row_id", "id", "f.seq", "f.opcode", F.when(F.col("f.opcode").isNull(), F.lower(F.hex("f.payload"))).otherwise(F.col("f.payload").cast("string")).alias("payload"))


PARTS = ("th", "an", "er", "on", "re", "he", "in", "nd", "ou", "ti")
MANY = [(a + b + c, f"K_{a}".upper()) for a in PARTS for b in PARTS for c in PARTS]


@query(f"""SELECT conv_id, turn, k AS keyword, category, (len(parts) - 1)::BIGINT AS n, strlen(parts[1])::INTEGER AS first_start FROM (SELECT conv_id, turn, k, 'K_' || upper(substr(k, 1, 2)) AS category, string_split(text, k) AS parts
  FROM (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), (SELECT unnest([{', '.join(sql.text(k) for k, _ in MANY)}]) AS k) WHERE contains(text, k))""")
def detect_many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand keywords in one pass."""
    rows = table(spark, sf_dir, "conversations").withColumn("segments", spans.safe_segments(F.col("text")))
    found = exploded(rows.select("conv_id", "turn", spans.detect("segments", [], MANY).alias("found")), "found")
    return found.groupBy("conv_id", "turn", F.col("h.original").alias("keyword"), F.col("h.category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("h.start").alias("first_start"))


NAMED = PiiEngine(KEY, [RuleList([Rule("keyword", "CITY", "New York")])], recognizers=[ner.segment_recognizer(ner.word_list(PLACES), language="auto", least_score=0.5)])
NAMED_TEXTS = [(1, "é Alice flew to New York on Monday"), (1, "Acme\x1b[0m of Rome"), (None, "Alice and Alice"), (None, None), (2, "none")]


@query(sql.dealt(sql.numbered([(1, f"é {token('Alice', 'PERSON')} flew to {token('New York', 'CITY')} on Monday", 2), (1, f"{token('Acme', 'ORG')}\x1b[0m of {token('Rome', 'LOCATION')}", 2), (None, f"{token('Alice', 'PERSON')} and {token('Alice', 'PERSON')}", 2), (None, None, 0), (2, "none", 0)]), "case_ int, id int, redacted string, n_hits int"))
def redact_with_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer beside rules: a rule's hit has priority, other entities are redacted too."""
    out = NAMED.redact(dealt(spark, sf_dir, NAMED_TEXTS, "id int, text string"))
    return out.select("row_id", "id", "redacted", F.greatest(F.size("hits"), F.lit(0)).alias("n_hits"))


REPORTED = [(1, "Alice, Bob and Alice"), (2, "none")]


@query(sql.dealt([(0, 1, 0, 15, "Alice"), (0, 1, 1, 7, "Bob"), (0, 1, 2, 0, "Alice")], "case_ int, id int, pos int, start_ int, original string", cases=2))
def hits_last_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as they are reported: by start, last first."""
    rows = PEOPLE.detect(dealt(spark, sf_dir, REPORTED, "id int, text string")).select("row_id", "id", F.posexplode_outer(spans.last_first(F.col("hits"))).alias("pos", "h")).filter("h is not null")
    return rows.select("row_id", "id", "pos", F.col("h.start").alias("start_"), "h.original")


def cut(text: str, step: int) -> list[str]:
    return [text[k:k + step] for k in range(0, len(text), step)]


SSE_CHUNKS = [(s, n, part, n == len(cut(body, 7)) - 1) for s, body in SSE for n, part in enumerate(cut(body, 7))]


def streamed(spark: SparkSession, rows: list[tuple], schema: str, transform, result: str, batches: int = 1) -> DataFrame:
    """What a streaming query makes of literal rows, in files that come one after another."""
    source, out = scratch_path(spark, "source"), scratch_path(spark, "out")
    for k in range(batches):
        literal_rows(spark, rows[k * len(rows) // batches:(k + 1) * len(rows) // batches], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result).parquet(out)


@query(sql.values(SSE_OUT, "stream_id string, seq long, event string"))
def sse_restore_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of sse_restore, cut every seven characters and streamed in two batches."""
    by_time = sorted(SSE_CHUNKS, key=lambda r: r[1])
    return streamed(spark, by_time, "stream_id string, seq long, fragment string, is_last boolean", lambda s: sse.restore_event_stream(s, {"__VG_NAME_0123456789ab__": "Alice"}), "stream_id string, seq long, event string", 2)


FILLED = [("s", "a", 1), ("s", "b", 2), ("t", "a", 1), ("s", "a", 3), ("s", "c", 4), ("s", "d", 4), ("t", "b", 9), ("s", "e", 5)]


@query(sql.values([("s", "a", 1), ("s", "b", 2), ("s", "c", 4)], "session_id string, placeholder string, created_at long"))
def session_evict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves sessions that hold two mappings."""
    return streamed(spark, FILLED, "session_id string, placeholder string, created_at long", lambda s: restorer.eviction_stream(s, 2), "session_id string, placeholder string, created_at long", 2)
