"""Columns made by Python, each in an operator of its own: evaluated once, whatever refers to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of an Arrow batch at most: what Python makes of one takes a multiple of it, in each worker of each core.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def with_python(df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable[..., tuple]) -> DataFrame:
    """df with new columns; compute gets a row's inputs and gives a value for each field."""
    small_batches(df.sparkSession)
    kinds, kept = [to_arrow_type(f.dataType) for f in fields], [c for c in df.columns if c not in {f.name for f in fields}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in inputs))
            made = list(zip(*(compute(*r) for r in rows))) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(m, k) for m, k in zip(made, kinds)], names=kept + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + fields))
