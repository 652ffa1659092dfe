"""Data sources for log files: session logs of framed, sealed records, and text logs that are followed while they grow.

session_log reads and writes (seq, entry). Each task writes a file of records (four bytes of length,
big-endian, then the entry); what a write has made stands in a list that is written last and named by
the batch, so a lost task's file is never read and a stream's batch that is repeated takes the place
of the first. Lists say where readers may begin, so a large file is read by many tasks. Files of other
writers, in a folder without lists, are read from their beginning; a cut last record is left out.

log_follow is a stream of a text file's lines. Its offset is the byte where the first line begins that
hasn't been given out; a poll looks at POLL_BYTES, and further only for the end of a long line. A file
that has become shorter is read from its beginning. What has no line feed yet waits.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Row, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

#: A reader of a session log may begin after so many bytes.
RANGE_BYTES = 16 << 20
#: A read has so many tasks for ranges at most, beside one for each file; of more, neighbours are read together.
MOST_RANGES = 512
LIST = "_records-"
#: Bytes of a poll, and of the longest line.
POLL_BYTES, LONGEST_LINE = 256 << 10, 1 << 20
RECORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("entry", T.BinaryType())])


class Written(WriterCommitMessage):
    def __init__(self, file: dict | None):
        self.file = file


class RecordWriter(DataSourceWriter, DataSourceStreamWriter):
    def __init__(self, path: str, range_bytes: int, batch: str | None):
        self.path, self.range_bytes, self.batch = path, range_bytes, batch

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        made, out, n = None, None, 0
        for row in iterator:
            if out is None:
                made = {"file": f"{uuid.uuid4().hex}.wal", "bytes": 0, "starts": [[0, 0]]}
                out = system.open_output_stream(f"{folder}/{made['file']}")
            if made["bytes"] - made["starts"][-1][0] >= self.range_bytes:
                made["starts"].append([made["bytes"], n])
            entry = bytes(row["entry"])
            out.write(struct.pack(">I", len(entry)) + entry)
            made["bytes"] += 4 + len(entry)
            n += 1
        if out is not None:
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None], batchId: int | None = None) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        name = self.batch or (uuid.uuid4().hex if batchId is None else f"batch-{batchId}")
        with system.open_output_stream(f"{folder}/{LIST}{name}.json") as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())

    def abort(self, messages: list[Written | None], batchId: int | None = None) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{folder}/{m.file['file']}")


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: int):
        super().__init__((file, start, end, first))


class RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        system, folder = fs.FileSystem.from_uri(self.path)
        there, files = system.get_file_info(fs.FileSelector(folder)), []
        lists = sorted((x for x in there if x.base_name.startswith(LIST)), key=lambda x: x.base_name)
        for x in lists:
            with system.open_input_stream(x.path) as f:
                files += json.loads(f.read())
        if not lists:
            files = [{"file": x.base_name, "bytes": x.size, "starts": [[0, 0]]} for x in sorted(there, key=lambda x: x.base_name) if x.base_name.endswith(".wal")]
        step = -(-sum(len(x["starts"]) for x in files) // MOST_RANGES) or 1
        taken = [(x, x["starts"][::step]) for x in files]
        return [Range(x["file"], a, b, n) for x, starts in taken for (a, n), (b, _) in zip(starts, [*starts[1:], [x["bytes"], 0]])] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        file, at, end, seq = partition.value
        if not file:
            return
        system, folder = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{folder}/{file}") as opened:
            opened.seek(at)
            while at + 4 <= end:
                n = struct.unpack(">I", opened.read(4))[0]
                if at + 4 + n > end:  # a cut last record
                    return
                yield (file, seq, opened.read(n))
                at, seq = at + 4 + n, seq + 1


class SessionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("batch"))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), None)


class LineFollower(SimpleDataSourceStreamReader):
    def __init__(self, path: str, poll_bytes: int = POLL_BYTES):
        self.path, self.poll_bytes = path, poll_bytes

    def initialOffset(self) -> dict:
        return {"turn": 0, "byte": 0}

    def _bytes(self, start: int, n: int) -> bytes:
        system, path = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(path) as f:
            return f.read_at(n, start)

    def _size(self) -> int:
        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        return info.size if info.type == fs.FileType.File else 0

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        size, turn, at = self._size(), start["turn"], start["byte"]
        if size < at:  # truncated
            turn, at = turn + 1, 0
        raw = self._bytes(at, self.poll_bytes) if size > at else b""
        if raw and b"\n" not in raw and size > at + len(raw):
            raw = self._bytes(at, max(LONGEST_LINE, self.poll_bytes))
            raw = raw if b"\n" in raw or len(raw) < LONGEST_LINE else raw + b"\n"  # a longer line is cut
        end = {"turn": turn, "byte": at + min(raw.rfind(b"\n") + 1, size - at)}
        return self.readBetweenOffsets({"turn": turn, "byte": at}, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["byte"] if start["turn"] == end["turn"] else 0
        raw = self._bytes(at, end["byte"] - at) if end["byte"] > at else b""
        lines = raw.removesuffix(b"\n").split(b"\n") if raw else []
        return iter([(x.removesuffix(b"\r").decode("utf-8", "replace"),) for x in lines])


class LogFollow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_follow"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: T.StructType) -> LineFollower:
        return LineFollower(self.options["path"], int(self.options.get("poll_bytes", POLL_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLog)
    spark.dataSource.register(LogFollow)
