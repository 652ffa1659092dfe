"""Which requests are redacted and which responses restored: gates, media types, encodings."""

from __future__ import annotations

import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import canonical_host, intercept_mode
from .python_columns import small_batches

LARGEST = 10 << 20
ENCODINGS = ("identity", "gzip", "br", "brotli", "deflate", "zstd")


def encodings(header: Column) -> Column:
    """Names in a Content-Encoding header, lower case, without parameters."""
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda e: F.trim(F.lower(F.substring_index(e, ";", 1))))
    return F.filter(names, lambda e: e != "")


def supported_encoding(header: Column) -> Column:
    return F.forall(encodings(header), lambda e: e.isin(*ENCODINGS))


def decompressed(body: bytes, name: str, most: int) -> bytes:
    """One layer taken away; ValueError if it can't be or is larger than `most`."""
    if name == "gzip":
        out, rest = b"", body
        while rest:
            d = zlib.decompressobj(31)
            out += d.decompress(rest, most + 1 - len(out))
            if not d.eof:
                raise ValueError("truncated or too large")
            rest = d.unused_data
    elif name == "deflate":
        out = None
        for bits in (15, -15):
            d = zlib.decompressobj(bits)
            try:
                out = d.decompress(body, most + 1)
                break
            except zlib.error:
                continue
        if out is None:
            raise ValueError("neither zlib nor raw deflate")
    elif name in ("br", "brotli", "zstd"):
        with pa.CompressedInputStream(pa.BufferReader(body), "zstd" if name == "zstd" else "brotli") as s:
            out = s.read(most + 1)
    else:
        out = body
    if len(out) > most:
        raise ValueError("too large")
    return out


def decoded(body: bytes | None, names: list[str], most: int = LARGEST) -> bytes | None:
    """All layers taken away, last first; None if that fails."""
    if body is None:
        return None
    try:
        for name in reversed(names):
            body = decompressed(bytes(body), name, most)
        return bytes(body)
    except (ValueError, zlib.error, OSError, pa.ArrowException, io.UnsupportedOperation):
        return None


def decoded_bodies(bodies: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([decoded(b, n) if n is not None else b for b, n in zip(bodies.to_pylist(), names.to_pylist())], pa.binary())


def decode_body(body: Column, names: Column) -> Column:
    """body without the encodings named; null if that fails."""
    small_batches(SparkSession.active())
    return F.arrow_udf(decoded_bodies, T.BinaryType())(body, names)


def header_tokens(header: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def without_deflate(extensions: Column) -> Column:
    """A WebSocket extension header without permessage-deflate; null if nothing is left."""
    kept = F.filter(header_tokens(extensions), lambda t: F.lower(F.trim(F.substring_index(t, ";", 1))) != "permessage-deflate")
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def is_upgrade(connection: Column, upgrade: Column) -> Column:
    return F.exists(header_tokens(connection), lambda t: F.lower(t) == "upgrade") & (F.lower(F.trim(F.coalesce(upgrade, F.lit("")))) == "websocket")


def is_textual(content_type: Column) -> Column:
    """As requests are tested: case counts."""
    c = F.coalesce(content_type, F.lit(""))
    return c.contains("application/json") | c.contains("text/") | c.contains("application/x-www-form-urlencoded")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def is_json_media(content_type: Column) -> Column:
    return media_type(content_type).contains("json")


def looks_like_events(body: Column) -> Column:
    """Of a body without a type: its first 256 bytes begin like server-sent events."""
    return F.decode(F.substring(body, 1, 256), "UTF-8").rlike(r"^\s*(?:data:|event:|id:|retry:|:)")


def gate(requests: DataFrame, mode: str = "global", targets: list[str] = ()) -> DataFrame:
    """requests with attempted, note and decoded; tests in order, the first that fails gives the note.

    Only bodies that pass all tests on headers and size are decompressed.
    """
    outside = (F.lit(mode) == "targets") & ~canonical_host(F.col("host")).isin(*(targets or [""]))
    upgrade = is_upgrade(F.col("connection"), F.col("upgrade"))
    strips = F.exists(header_tokens(F.col("extensions")), lambda t: F.lower(F.substring_index(t, ";", 1)).contains("permessage-deflate"))
    size = F.octet_length("body")
    before = (
        F.when(outside, "pass_through").when(upgrade & strips, "websocket_upgrade_strip_permessage_deflate").when(upgrade, "websocket_upgrade").when(F.col("body").isNull() | (size == 0), "no_body")
        .when(~is_textual(F.col("content_type")), "not_text").when(~supported_encoding(F.col("content_encoding")), "encoded").when((F.coalesce(F.col("declared_len"), F.lit(0)) > LARGEST) | (size > LARGEST), "too_large")
        .when(F.col("read_failed"), "read_error")
    )
    rows = requests.withColumn("note", before)
    passed = F.col("note").isNull()
    rows = rows.withColumn("decoded", decode_body(F.when(passed, F.col("body")), encodings(F.when(passed, F.col("content_encoding")))))
    after = F.when(passed & F.col("decoded").isNull(), "decode_error").when(passed & ~F.is_valid_utf8(F.col("decoded").cast("string")), "not_utf8").otherwise(F.coalesce("note", F.lit("")))
    return rows.withColumn("note", after).withColumn("attempted", F.col("note") == "")


def response_route(responses: DataFrame) -> Column:
    """Which restoration a response (status, content_type, redacted, encoded, declared_len, body) takes."""
    kind = media_type(F.col("content_type"))
    sniffed = (kind == "") & F.col("redacted") & looks_like_events(F.col("body"))
    return (
        F.when(F.col("status") == 101, "websocket").when((kind == "text/event-stream") | sniffed, "events").when(kind.contains("json") & (F.coalesce(F.col("declared_len"), F.lit(0)) > LARGEST), "pass")
        .when(kind.contains("json") & (F.col("declared_len") < 0), "stream").when(kind.contains("json"), "whole").when(kind.startswith("text/"), "stream")
        .when((kind == "") & F.col("redacted") & ~F.col("encoded"), "stream").otherwise("pass")
    )


__all__ = ["decode_body", "decoded", "encodings", "gate", "intercept_mode", "is_json_media", "is_textual", "is_upgrade", "looks_like_events", "response_route", "supported_encoding", "without_deflate"]
