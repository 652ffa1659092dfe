"""WARC archives as a Spark data source, with revisit records for equal payloads.

Writing: each task writes files of records and the committed list of files (_archives-*.json, with
places where a reader may start) is written last, so files of lost or repeated tasks are never read.
Each write adds a list of its own, and all lists of a folder are read. In a folder without any, such
as others have written, every .warc file is read as one part.
Reading: file ranges become partitions; filters on record_type, record_id, target_uri and refers_to
are pushed down; a record's header is parsed first and the payload of a record that isn't wanted is
skipped by its length, never decoded (nor fetched, beyond what a buffered request holds). Option
payload=false skips all payloads.

Archives must lie where Python can write, by a path or URI that pyarrow.fs knows.

Null html counts as empty. Null urls are written as an empty URI. Rows that share page_id are all
written; of equal payloads those with the largest page_id are responses. A null page_id is never the
largest unless all are null. An empty table gives archives without records.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import small_batches, stored

SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType()),
])
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
#: A reader may start after so many bytes; a file ends after so many.
RANGE_BYTES, FILE_BYTES, BATCH_BYTES = 16 << 20, 256 << 20, 8 << 20
#: Bytes of a request for payloads, and of one for headers alone.
PAYLOAD_REQUEST, HEADER_REQUEST = 1 << 20, 64 << 10
MANIFEST = "_archives-"
#: Payloads under this size are always written whole.
LEAST_REVISIT = 1000
#: Payloads found twice are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (row["payload"] or b"")
    lines = ["WARC/1.1", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response"]
    lines += [f"{name}: {clean(str(row[key]))}" for key, name in HEADERS.items() if row[key] is not None]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES):
        self.path, self.range_bytes, self.file_bytes = path, range_bytes, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append({"file": f"{uuid.uuid4().hex}.warc", "bytes": 0, "starts": [0]})
                    out = system.open_output_stream(f"{folder}/{files[-1]['file']}")
                now = files[-1]
                if now["bytes"] - now["starts"][-1] >= self.range_bytes:
                    now["starts"].append(now["bytes"])
                made = record(row)
                out.write(made)
                now["bytes"] += len(made)
                if now["bytes"] >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{folder}/{f['file']}")


class Buffered:
    """Reads of a file by place, in requests of `size` bytes at least."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, self.size), at)
        return self.held[at - self.at:at - self.at + n]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, request_bytes: int | None = None):
        self.path, self.with_payload, self.wanted = path, with_payload, []
        self.request_bytes = request_bytes or (PAYLOAD_REQUEST if with_payload else HEADER_REQUEST)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("record_type", "record_id", "target_uri", "refers_to") and isinstance(f, (EqualTo, In, IsNotNull)):
                self.wanted.append((column, None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, folder = fs.FileSystem.from_uri(self.path)
        there, files = system.get_file_info(fs.FileSelector(folder)), []
        lists = [x for x in there if x.base_name.startswith(MANIFEST)]
        for x in sorted(lists, key=lambda x: x.base_name):
            with system.open_input_stream(x.path) as f:
                files += json.loads(f.read())
        if not lists:
            files = [{"file": x.base_name, "bytes": x.size, "starts": [0]} for x in sorted(there, key=lambda x: x.base_name) if x.base_name.endswith(".warc")]
        return [Range(x["file"], a, b) for x in files for a, b in zip(x["starts"], [*x["starts"][1:], x["bytes"]])] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        file, start, end = partition.value
        if not file:
            return
        system, folder = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with system.open_input_file(f"{folder}/{file}") as opened:
            f, at = Buffered(opened, self.request_bytes), start
            while at < end:
                header, body_at = self.header(f, at)
                length = int(header["Content-Length"])
                at = body_at + length + 4
                row = {k: header.get(name) for k, name in HEADERS.items()}
                if any(row[c] is None or values is not None and row[c] not in values for c, values in self.wanted):
                    continue
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                row["payload"] = None
                if self.with_payload and row["record_type"] == "response":
                    row["payload"] = f.read_at(length, body_at).partition(b"\r\n\r\n")[2]
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield arrow(rows)
                    rows, held = [], 0
        if rows:
            yield arrow(rows)

    @staticmethod
    def header(f, at: int) -> tuple[dict[str, str], int]:
        head, size = b"", 1024
        while (stop := head.find(b"\r\n\r\n")) < 0:
            head, size = f.read_at(size, at), size * 4
        version, *lines = head[:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}: {version[:40]!r}")
        return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines), at + stop + 4


def arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in SCHEMA.names], names=SCHEMA.names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("request_bytes", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def id_of(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, **options) -> None:
    """One record for each row; of equal payloads the largest id's is the response, others are revisits without payload.

    options: range_bytes and file_bytes, after which a reader may start and a file ends.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    payload = F.coalesce(F.encode(pages[html_col].cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    twice = rows.filter(F.col("payload_length") >= least).groupBy("payload_digest", "payload_length").agg(F.max("id").alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twice = stored(twice, "payloads")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    rows = rows.join(twice, ["payload_digest", "payload_length"], "left")
    again = F.col("kept_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept_id"))
    rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), page_uri(F.col("id")).alias("record_id"), "target_uri", F.when(again, page_uri(F.col("kept_id"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").options(**options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).option("payload", str(payload).lower()).load(path)


def page_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of responses by their payloads, of revisits by their headers; one read of the archives."""
    rows, whole = read_archive(spark, path, **options), F.col("record_type") == "response"
    return rows.select(
        id_of(F.col("record_id")).alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", id_of(F.col("refers_to")).alias("refers_to"),
    )
