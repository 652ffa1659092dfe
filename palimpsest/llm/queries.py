"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import centroids, chat, decontamination, jaccard_join, language_id, late_overwrite, licenses, line_rules, mixing, quality_crf, token_orc, url_filter, warc
from .common import scratch_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, byte_bpe())
    return token_orc.token_digests(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    label = lambda of: F.array_join(F.array_sort(F.array_distinct(of)), ",")
    starts = F.transform("base", lambda x: x["word"].cast("long"))
    labels = F.concat(F.transform("base", lambda x: x["label"]), F.transform("notices", lambda x: x["label"]))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        label(F.transform("base", lambda x: x["label"])).alias("base_labels"), label(labels).alias("labels"), "score", F.size("notices").cast("long").alias("n_notices"))


def held_out(of: int, value: int) -> Column:
    return F.coalesce(language_id.remainder(F.col("doc_id"), of) == value, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn_languages(language_id.learning_rows(docs, "doc_id", "text", "lang"))
    found = language_id.identify_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "letters")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.learn_quality(quality_crf.learning_rows(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality"))
    return quality_crf.score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(stored(chat.format_turns(rows.unionByName(more)), "chat"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    hashes = spark.createDataFrame(list(enumerate(centroids.centroid_hashes(found.centroids))), "cluster int, centroid_sha256 string")
    inertia = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = inertia.agg(F.sum("cluster_inertia").alias("x")).first().x  # one number
    figures = inertia.join(hashes, "cluster").withColumn("inertia", F.lit(whole).cast("long"))
    return found.rows.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


# Rules that come first, and hosts that are blocked where no rule fits.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_HOSTS = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [(*rule, 1) for rule in URL_RULES] + [(host, "", "block", 0) for host in LISTED_HOSTS]
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(listed, "host string, path string, verdict string, priority int"), keep=["page_id"])
    rule = F.when(F.col("priority") == 1, F.concat("entry_host", "entry_path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict", F.col("entry_host").alias("listed_host"))


LATE_FROM = "2024-03-20 00:00:00"
FILES = 1100


def with_copies(sales: DataFrame) -> DataFrame:
    """sales, and of some rows a copy that arrives later, perhaps with another day."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    day = late_overwrite.Layout("", sales.schema, "sale_id", "sold_at", "arrived_at", 1)
    named = sales.toDF(*day.names).withColumn("day", day.day()).toDF(*sales.columns, "day_in_hand")
    days = lambda n: F.make_dt_interval(n.cast("int"))
    copies = named.filter((h % 3 == 0) & (F.pmod("day_in_hand", F.lit(4)) == 0)).drop("day_in_hand")
    copies = copies.withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    return sales.unionByName(copies)


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    sales = sales.select("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")
    layout = late_overwrite.Layout(scratch_path(spark, "sales"), sales.schema, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // FILES)
    rows = with_copies(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(LATE_FROM).cast(sales.schema["arrived_at"].dataType), F.lit(False))
    late_overwrite.write_layout(rows.filter(early), layout)
    days = late_overwrite.merge_late(rows.filter(~early), layout)
    standing = layout.standing(spark)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    time = lambda c: text(late_overwrite.micros(F.col(layout.name(c)), sales.schema[c].dataType))
    id_ = F.col(layout.name("sale_id"))
    crc = F.crc32(F.concat_ws(":", text(id_), time("sold_at"), time("arrived_at")).cast("binary"))
    cents = F.coalesce(F.floor(100 * F.col(layout.name("total")) + 0.5).cast("long"), F.lit(0).cast("long"))
    digests = late_overwrite.file_digests(standing.select("day", "part", "row_index", id_.alias("id"), cents.alias("cents"), crc.alias("crc")))
    files = late_overwrite.layout_files(spark, layout).select("day", "part", "file_no", "path")
    columns = ",".join(late_overwrite.layout_columns(spark, layout)) if files.limit(1).count() else ""
    return digests.join(files, ["day", "part"]).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", F.col("day").isin(days).alias("rewritten"))


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_decontaminate, op3_jaccard_join, op4_licenses, op5_language, op6_quality, op7_line_rules, op8_chat, op9_warc, op10_mix_sources, op11_centroids, op12_url_filter, op13_late_overwrite)}
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '{PLAIN}') AS words FROM documents),
b AS (SELECT item_id, words, least({decontamination.WINDOW}, len(words)) AS n FROM (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '{PLAIN}') AS words FROM benchmark) WHERE len(words) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT r, count(DISTINCT cell) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS cell FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) + max(CASE WHEN item_id IS NULL THEN 1 ELSE 0 END) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)), ',') AS names FROM m GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontamination.SHARE} * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT r, doc_id, s FROM (SELECT r, doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM d WHERE len(words) > 0))),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_ AS (SELECT a.r AS ra, b.r AS rb, a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON ra = x.r JOIN n y ON rb = y.r WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.other = edge.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN comp ON d.doc_id = comp.id
"""

ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS x(i)),
f AS (SELECT *, 15 + length({ESCAPED.format("text")}) + length(replace({ESCAPED.format("role")}, ':', '\:')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS kept, count(*) AS n FROM p WHERE strlen(html) >= {warc.LEAST_REVISIT} GROUP BY html HAVING count(*) > 1)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM p LEFT JOIN k ON p.html = k.html
"""

LISTED_SQL = ", ".join(f"('{h}', '{p}', '{v}', 1)" for h, p, v in URL_RULES) + ", " + ", ".join(f"('{h}', '', 'block', 0)" for h in LISTED_HOSTS)
URL_SQL = rf"""
WITH l(lh, lp, lv, pri) AS (VALUES {LISTED_SQL}),
u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT r, lh, lp, lv, pri, row_number() OVER (PARTITION BY r ORDER BY pri DESC, length(lh) DESC, length(lp) DESC) AS k FROM u JOIN l ON (host = lh OR ends_with(host, '.' || lh)) AND starts_with(path, lp))
SELECT page_id, host, path, CASE WHEN pri = 1 THEN lh || lp END AS rule, coalesce(lv, 'allow') AS verdict, lh AS listed_host FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": DECONTAMINATION_SQL, "op3_jaccard_join": JACCARD_SQL, "op7_line_rules": line_rules.ORACLE_SQL, "op8_chat": CHAT_SQL, "op9_warc": WARC_SQL, "op12_url_filter": URL_SQL}
