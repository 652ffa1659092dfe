"""Requests as rows, from files that lie there or that come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.requests import LARGEST

REQUESTS = "id long, host string, method string, path string, content_type string, content_encoding string, connection string, upgrade string, extensions string, body binary, declared_len long, read_failed boolean"


def shaped(rows: DataFrame) -> DataFrame:
    """All columns of REQUESTS, null where a file hasn't them; a body keeps one byte more than may be redacted, so that the gate sees it is too large."""
    given = set(rows.columns)
    want = rows.sparkSession.createDataFrame([], REQUESTS).schema
    columns = {f.name: (F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)) for f in want.fields}
    columns["declared_len"] = F.coalesce(columns["declared_len"], F.octet_length(columns["body"]).cast("long"))
    columns["body"] = F.substring(columns["body"], 1, LARGEST + 1)
    columns["read_failed"] = F.coalesce(columns["read_failed"], F.lit(False))
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def read_requests(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """From Parquet files, or JSON lines with bodies in base64."""
    rows = spark.read.schema(REQUESTS).format(kind).load(path)
    return shaped(rows)


def request_stream(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return shaped(spark.readStream.schema(REQUESTS).format(kind).load(path))
