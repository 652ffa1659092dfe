"""Log files: the framed, sealed session log, and text logs that grow."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def framed(entries: list[bytes]) -> bytes:
    """Each entry after its length (four bytes, big-endian)."""
    return b"".join(struct.pack(">I", len(e)) + e for e in entries)


def unframed(raw: bytes | None) -> list[bytes]:
    """The whole entries; a cut last one is left out."""
    found, at, raw = [], 0, bytes(raw or b"")
    while at + 4 <= len(raw):
        n = struct.unpack_from(">I", raw, at)[0]
        if at + 4 + n > len(raw):
            break
        found.append(raw[at + 4:at + 4 + n])
        at += 4 + n
    return found


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def entries_of(raw: pd.Series) -> pd.Series:
    return raw.map(unframed)


def read_framed_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, entry) of files of framed entries: nonce, ciphertext and tag, as AES-GCM functions take them."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.select("file", F.posexplode(entries_of("content")).alias("seq", "entry"))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of lines of the text files that come to a folder."""
    return spark.readStream.text(folder)


def tail_file(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(line_no from the end, value) of a text file's last n lines, in order; one task reads each block, and only n lines of each leave it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    last = rows.orderBy(F.col("file").desc(), F.col("block").desc(), F.col("place").desc()).limit(n)
    return last.orderBy("file", "block", "place").select("value")
