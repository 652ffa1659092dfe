"""Placeholders and the dictionary that leads back from them to what they stand for."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PREFIX = "__VG_"  # fixed value
DIGITS = 12


def random_key() -> bytes:
    return secrets.token_bytes(32)


def derived_key(secret: bytes, use: str) -> bytes:
    """A key of 32 bytes for one use."""
    return hashlib.sha256(hashlib.sha256(secret).digest() + f"palimpsest/{use}".encode()).digest()


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Lower-case hex, by two SHA-256 passes over padded keys."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = F.lit(bytes(b ^ 0x36 for b in block)), F.lit(bytes(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def placeholder(key: bytes, category: Column, original: Column, prefix: str = PREFIX) -> Column:
    """prefix, category and twelve digits of the keyed hash; the hash leaves the category out."""
    return F.concat(F.lit(prefix), category, F.lit("_"), F.substring(hmac_sha256(key, original), 1, DIGITS), F.lit("__"))


def build_mapping(hits: DataFrame, key: bytes, prefix: str = PREFIX, name: Callable[[bytes, Column, Column, str], Column] = placeholder) -> DataFrame:
    """(placeholder, original, category, created_at) from hits (doc_ord, start, category, original, created_at).

    An original takes the category of its first hit: documents in order, the last span of each first.
    Different originals with one placeholder are numbered from 2 in that order.
    """
    # the first hit of an original is a minimum, which is gathered before the shuffle; no original's hits are sorted
    first = hits.groupBy("original").agg(F.min(F.struct(F.col("doc_ord"), (-F.col("start")).alias("s"), F.col("category"), F.col("created_at"))).alias("f"))
    first = first.select("original", "f.category", "f.created_at", "f.doc_ord", "f.s", name(key, F.col("f.category"), F.col("original"), prefix).alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy("doc_ord", "s", "original"))
    numbered = F.when(n > 1, F.concat(F.expr("substring(base, 1, length(base) - 2)"), F.lit("_"), n.cast("string"), F.lit("__"))).otherwise(F.col("base"))
    return first.select(numbered.alias("placeholder"), "original", "category", "created_at")


def register(mapping: DataFrame, more: DataFrame) -> DataFrame:
    """mapping with those of `more` whose original it hasn't."""
    return mapping.unionByName(more.join(mapping.select("original"), "original", "left_anti"))


def evict(mapping: DataFrame, most: int) -> DataFrame:
    """The newest `most` by created_at, placeholders breaking ties; top-N, so no partition is sorted as a whole."""
    return mapping.orderBy(F.col("created_at").desc(), F.col("placeholder").desc()).limit(most)


def unexpired(mapping: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return mapping.filter(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def lookup(mapping: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(placeholder, original) of placeholders; the time to live isn't looked at."""
    return placeholders.select("placeholder").distinct().join(mapping.select("placeholder", "original"), "placeholder")


def reverse(mapping: DataFrame, originals: DataFrame) -> DataFrame:
    """(original, placeholder) of originals."""
    return originals.select("original").distinct().join(mapping.select("original", "placeholder"), "original")


def gauges(mapping: DataFrame, most: int, ttl_seconds: int) -> DataFrame:
    """One row: how many mappings a session holds, may hold, and for how long."""
    return mapping.agg(F.count(F.lit(1)).alias("active"), F.lit(most).cast("long").alias("most"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))


def cleared(mapping: DataFrame) -> DataFrame:
    return mapping.limit(0)


def listed_category(placeholder_: Column) -> Column:
    """What a listing shows: letters up to the first underscore after the standard prefix, else UNKNOWN."""
    return F.coalesce(F.nullif(F.regexp_extract(placeholder_, f"^{PREFIX}([^_]+)_", 1), F.lit("")), F.lit("UNKNOWN"))


def search(mapping: DataFrame, text: str = "") -> DataFrame:
    """Placeholders with their listed category whose name or category holds text; originals aren't shown."""
    from ..functions.text import contains_fold

    rows = mapping.select("placeholder", listed_category(F.col("placeholder")).alias("listed_category"), "created_at")
    part = F.lit(text)
    return rows.filter(contains_fold(F.col("placeholder"), part) | contains_fold(F.col("listed_category"), part)) if text else rows


def seal_log(mapping: DataFrame, key: bytes) -> DataFrame:
    """Log rows (seq, entry): the mapping as sealed JSON, AES-256-GCM; categories aren't written."""
    entry = F.to_json(F.struct("placeholder", "original", F.unix_micros("created_at").alias("created_at")))
    return mapping.select("seq", F.aes_encrypt(entry.cast("binary"), F.lit(key), F.lit("GCM")).alias("entry"))


def restore_log(log: DataFrame, key: bytes, now: Column, ttl_seconds: int) -> DataFrame:
    """The mapping from a log: rows that can't be opened or read and expired ones are left out; of an original the first stays."""
    opened = F.from_json(F.try_aes_decrypt("entry", F.lit(key), F.lit("GCM")).cast("string"), "placeholder string, original string, created_at long")
    rows = log.select("seq", opened.alias("e")).filter("e.placeholder is not null and e.original is not null").select("seq", "e.placeholder", "e.original", F.timestamp_micros("e.created_at").alias("created_at"))
    rows = unexpired(rows, now, ttl_seconds)
    return rows.groupBy("original").agg(F.min_by(F.struct("placeholder", "created_at"), "seq").alias("f")).select("f.placeholder", "original", "f.created_at")
