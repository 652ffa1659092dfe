"""Session logs in their file format, and text logs that grow and shrink."""

import struct
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.scratch import scratch_path
from palimpsest.sources import log_files


def local(path):
    return Path(path.removeprefix("file://"))


def test_records_come_back_whole_and_by_ranges(spark):
    log_files.register(spark)
    path = scratch_path(spark, "wal")
    rows = spark.range(1000).select(F.lit("").alias("file"), F.col("id").alias("seq"), F.encode(F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "id"), "UTF-8").alias("entry")).repartition(3)
    rows.write.format("session_log").option("range_bytes", "700").mode("append").save(path)
    back = spark.read.format("session_log").load(path)
    assert sorted(bytes(r.entry) for r in back.collect()) == sorted(bytes(r.entry) for r in rows.collect()) and back.rdd.getNumPartitions() > 20
    assert back.select("file", "seq").distinct().count() == 1000
    # a file that no list names, as a lost task leaves it, isn't read; a batch that is repeated counts once
    (local(path) / "lost.wal").write_bytes(struct.pack(">I", 3) + b"abc")
    for _ in range(2):
        rows.limit(5).write.format("session_log").option("batch", "b1").mode("append").save(path)
    assert spark.read.format("session_log").load(path).count() == 1005
    for x in local(path).glob(f"{log_files.LIST}*"):
        x.unlink()
    with open(local(path) / "lost.wal", "ab") as f:
        f.write(b"\x00\x00\x00\xffcut")
    assert spark.read.format("session_log").load(path).filter(F.col("file") == "lost.wal").count() == 1
    empty = scratch_path(spark, "wal")
    rows.limit(0).write.format("session_log").mode("append").save(empty)
    assert spark.read.format("session_log").load(empty).count() == 0


def test_records_of_a_stream(spark):
    log_files.register(spark)
    source, path, state = (scratch_path(spark, n) for n in ("in", "wal", "state"))
    rows = spark.range(200).select(F.lit("").alias("file"), F.col("id").alias("seq"), F.encode(F.col("id").cast("string"), "UTF-8").alias("entry"))
    for part in (0, 1):
        rows.filter(F.col("seq") % 2 == part).write.mode("append").parquet(source)
        spark.readStream.schema(rows.schema).parquet(source).writeStream.format("session_log").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    assert sorted(int(bytes(r.entry)) for r in spark.read.format("session_log").load(path).collect()) == list(range(200))


def test_lines_are_followed_while_a_file_grows_and_shrinks(spark, sf_dir):
    log_files.register(spark)
    lines = [f"{r.doc_id} {(r.text or '')[:40]}".replace("\n", " ").replace("\r", " ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    path = scratch_path(spark, "log") + ".txt"
    local(path).parent.mkdir(parents=True, exist_ok=True)
    whole = "".join(x + "\n" for x in lines).encode()
    local(path).write_bytes(whole[:3001])
    out, state = scratch_path(spark, "followed"), scratch_path(spark, "state")
    start = lambda: spark.readStream.format("log_follow").option("path", path).option("poll_bytes", "1000").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    got = lambda: [r.value for r in spark.read.parquet(out).collect()]
    q = start()
    q.processAllAvailable()
    seen = whole[:3001].decode("utf-8", "ignore").split("\n")[:-1]
    assert sorted(got()) == sorted(seen)  # the last, cut line waits
    with open(local(path), "ab") as f:
        f.write(whole[3001:])
    q.processAllAvailable()
    q.stop()
    assert sorted(got()) == sorted(lines)
    local(path).write_bytes(b"new\r\n" + b"y" * 5000 + b"\nopen")  # shorter: from the beginning
    q = start()  # on the checkpoint
    q.processAllAvailable()
    q.stop()
    assert sorted(got()) == sorted([*lines, "new", "y" * 5000])


def test_small_ranges_are_read_together(spark, tmp_path, monkeypatch):
    """The tasks of a read don't grow with the number of ranges."""
    from palimpsest.sources import log_files

    log_files.register(spark)
    path = f"file://{tmp_path}/wal"
    rows = spark.range(0, 400, numPartitions=2).selectExpr("'' AS file", "id AS seq", "CAST(CAST(id AS STRING) AS BINARY) AS entry")
    rows.write.format("session_log").option("batch", "one").option("range_bytes", "16").mode("append").save(path)
    every = log_files.RecordReader(path).partitions()
    monkeypatch.setattr(log_files, "MOST_RANGES", 10)
    reader = log_files.RecordReader(path)
    some = reader.partitions()
    assert len(every) > 100 and len(some) <= 12
    read = lambda parts: [r for p in parts for r in reader.read(p)]
    assert read(some) == read(every) and len(read(some)) == 400
