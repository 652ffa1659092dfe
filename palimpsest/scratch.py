"""Tables and files of the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode without one, in a folder of our own that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = f"file://{folder}"
        base = _own[app]
    return f"{base.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read from there: what follows survives lost executors and isn't computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
