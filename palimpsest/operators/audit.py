"""Audit events, debug captures, rule lists and their subscriptions as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import preview, truncate

RING, DEBUG_RING, MATCHES, MATCH_CHARS = 200, 50, 50, 256
DEFAULT_INTERVAL, LEAST_INTERVAL = 24 * 3600, 600
LARGEST_LIST = 10 << 20
DEBUG_BODY, LEAST_DEBUG_BODY, LARGEST_DEBUG_BODY = 1 << 20, 4 << 10, 20 << 20


def upsert(events: DataFrame, updates: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest row of each key: a maximum, gathered before the shuffle."""
    both = events.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def last(events: DataFrame, n: int = RING, key: str = "id") -> DataFrame:
    """The newest n (1 to 500), ascending; top-N, not a sort of all."""
    return events.orderBy(F.col(key).desc()).limit(min(500, max(1, n))).orderBy(key)


def next_id(events: DataFrame, key: str = "id") -> DataFrame:
    return events.agg(F.coalesce(F.max(key), F.lit(0)).alias("max_id"))


def purge(events: DataFrame, now: Column, retention_seconds: int, time: str = "time") -> DataFrame:
    """Compares times, not texts."""
    return events.filter(F.col(time) >= now - F.make_dt_interval(secs=F.lit(retention_seconds)))


def shown_matches(matches: Column, private: bool = True) -> Column:
    """The first MATCHES hits: value cut, then in privacy mode only its ends."""

    def one(m: Column) -> Column:
        value, cut = m["original"], F.length(m["original"]) > MATCH_CHARS
        kept = truncate(value, MATCH_CHARS)
        return F.struct(m["category"].alias("category"), m["placeholder"].alias("placeholder"), (preview(kept) if private else kept).alias("value"), F.lit(private).alias("is_preview"), F.length(value).alias("length"), cut.alias("truncated"))

    return F.transform(F.slice(matches, 1, MATCHES), one)


def stats(events: DataFrame) -> DataFrame:
    """One row; restored_count is never counted by the reference and stays 0."""
    return events.agg(
        F.count_if(F.col("method") != "CONNECT").alias("total_requests"), F.count_if(F.col("attempted") & (F.col("redacted_count") > 0) & (F.col("note") != "invalid_json")).alias("redacted_requests"),
        F.count_if("restore_applied").alias("restored_requests"), F.count_if(F.col("note").isin("read_error", "decode_error")).alias("errors"), F.lit(0).cast("long").alias("restored_count"),
    )


def merge_debug(requests: DataFrame, responses: DataFrame, most: int = DEBUG_RING) -> DataFrame:
    """Captures (id, body, truncated) of requests and responses beside each other, the newest ids."""
    a = requests.select("id", F.struct("body", "truncated").alias("request"))
    b = responses.select("id", F.struct("body", "truncated").alias("response"))
    rows = a.join(b, "id", "full").select("id", F.col("request").isNotNull().alias("has_request"), F.col("response").isNotNull().alias("has_response"), (F.coalesce("request.truncated", F.lit(False)) | F.coalesce("response.truncated", F.lit(False))).alias("truncated"))
    return last(rows, most)


def body_cap(asked: int) -> int:
    """Bytes of a body that a capture keeps: what is asked for within bounds, DEBUG_BODY for nothing."""
    return min(LARGEST_DEBUG_BODY, max(LEAST_DEBUG_BODY, asked)) if asked > 0 else DEBUG_BODY


def get_debug(requests: DataFrame, responses: DataFrame, wanted: int) -> DataFrame:
    """(id, request, response) of one capture."""
    of = lambda rows, name: rows.filter(F.col("id") == wanted).select("id", F.struct("body", "truncated").alias(name))
    return of(requests, "request").join(of(responses, "response"), "id", "full")


def interval_seconds(text: Column) -> Column:
    """Hours or days ("24h", "7d", "30m"); not under the least, the default for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([dhms])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([dhms])$", 2)
    value = F.when(n != "", n.cast("long") * F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1))
    return F.greatest(F.coalesce(F.nullif(value, F.lit(0)), F.lit(DEFAULT_INTERVAL)), F.lit(LEAST_INTERVAL))


def merge_subscriptions(meta: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """meta (key, url, etag, checked_at, updated_at, content_sha256, last_error, update_interval) after fetches (key, new_url, status, body, new_etag, parses).

    Not due: nothing changes. A new URL forgets what was known. 304 and equal contents change only the
    time of checking; refused, too large or unreadable lists only the error, and the old one stays.
    """
    rows = meta.join(fetched, "key", "left")
    due = rows["status"].isNotNull() & ((now - F.col("checked_at") >= interval_seconds(F.col("update_interval"))) | (F.col("new_url") != F.col("url")))
    moved = due & (F.col("new_url") != F.col("url"))
    old_sha, old_etag = F.when(~moved, F.col("content_sha256")), F.when(~moved, F.col("etag"))
    sha = F.sha2(F.col("body").cast("binary"), 256)
    error = F.when(F.col("status") == 304, F.lit(None)).when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).when(F.octet_length("body") > LARGEST_LIST, "too large").when(~F.col("parses"), "parse error")
    good = due & (F.col("status") == 200) & error.isNull()
    changed = good & ~sha.eqNullSafe(old_sha)
    return rows.select(
        "key", F.when(due, F.coalesce("new_url", "url")).otherwise(F.col("url")).alias("url"), F.when(good, F.col("new_etag")).otherwise(F.when(due, old_etag).otherwise(F.col("etag"))).alias("etag"),
        F.when(due, F.lit(now)).otherwise(F.col("checked_at")).cast("long").alias("checked_at"), F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"),
        F.when(changed, sha).otherwise(F.when(due, old_sha).otherwise(F.col("content_sha256"))).alias("content_sha256"), F.when(due, error).otherwise(F.col("last_error")).alias("last_error"), changed.alias("changed"),
    )


def rule_list_status(lists: DataFrame, meta: DataFrame) -> DataFrame:
    """Lists (key, name, is_subscription) with kind and whether their contents are verified."""
    rows = lists.join(meta.select("key", "last_error", "content_sha256"), "key", "left")
    kind = F.when(F.col("is_subscription"), "subscription").otherwise("local")
    return rows.select("key", "name", kind.alias("kind"), (F.col("is_subscription") & F.coalesce(F.col("last_error"), F.lit("")).eqNullSafe("") & F.coalesce(F.col("content_sha256") != "", F.lit(False))).alias("verified"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n of (seq, value) in order."""
    return lines.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def reassembled(frames: DataFrame) -> DataFrame:
    """Messages of WebSocket data frames (conn, dir, seq, fin, rsv, opcode, payload), control frames left out.

    A message's number is the running count of its direction's first frames. Text of frames without
    reserved bits can be changed; other messages, and continuations without a start, pass as they are.
    """
    data = frames.filter("opcode < 8").withColumn("message", F.sum(F.when(F.col("opcode") > 0, 1).otherwise(0)).over(W.partitionBy("conn", "dir").orderBy("seq")).cast("long"))
    parts = data.groupBy("conn", "dir", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "fin", "rsv", "opcode", "payload"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["payload"]), "")
    whole = (F.col("message") > 0) & (F.col("p")[0]["opcode"] == 1) & (F.col("p")[0]["rsv"] == 0) & F.element_at("p", -1)["fin"]
    return parts.select("conn", "dir", "message", F.size("p").cast("long").alias("n_frames"), text.alias("payload"), whole.alias("is_text"))
