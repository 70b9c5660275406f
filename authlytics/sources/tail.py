"""Growing log files as a stream: what the file source doesn't read.

Spark's file source takes whole new files; a log is one file that grows, is renamed and
begun anew (rotation), or emptied in place (truncation). This Python data source reads the
bytes appended since the last micro-batch:

* The offset of the stream is, for every file, a byte position with a check sum of the bytes
  before it. A file is known by what stays when it's renamed: its inode (on a local file
  system; elsewhere its path) and its first line. A smaller size or another check sum means
  that the file was emptied and written anew: it starts again at 0 under a new name.
* A last line without a line end is held back until it has one.
* ``max_lines`` bounds a micro-batch; the positions of its end are found by reading no more
  than those lines. Files are taken in turn by name, rotated ones too if the pattern
  matches them.
* While the file ``hold`` exists, no batch takes new lines: whoever appends to several files can
  hold the stream until all of them are complete, so that it never has the lines of one
  host without those of the others from the same time (they would be late afterwards).
* The bytes of a batch are read by the executors, in parts of ``part_bytes``; a part gives the
  lines that begin in it. The checkpoint of the query makes this exactly-once.

Bytes that are emptied away before a batch has read them can't be known. Lines that aren't
UTF-8 get replacement characters; CR before the line end is dropped. On a local file system
all executors must see the files (a shared mount).
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "growing_logs"
SCHEMA = "value string, source string, file string, pos long"
CHUNK = 1 << 20
CHECKED = 64
#: First bytes of a first line that tell files apart.
HEAD = 256


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _bytes(fs: pafs.FileSystem, path: str, start: int, end: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(end - start, start) if end > start else b""


def _identity(fs: pafs.FileSystem, path: str, size: int) -> str | None:
    """What stays of a file when it's renamed; None while its first line isn't complete."""
    head = _bytes(fs, path, 0, min(size, HEAD))
    if b"\n" not in head and len(head) < HEAD:
        return None
    place = os.stat(path).st_ino if isinstance(fs, pafs.LocalFileSystem) else path
    return f"{place}-{zlib.crc32(head.split(b'\n')[0]):08x}"


def _files(pattern: str) -> Iterator[tuple[pafs.FileSystem, str, int, str]]:
    """(file system, path, size, identity) of the files that match, by name."""
    fs, path = _open(pattern)
    folder, name = posixpath.split(path)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    for info in sorted(found, key=lambda i: i.base_name):
        if info.type == pafs.FileType.File and fnmatch.fnmatch(info.base_name, name):
            try:
                if (identity := _identity(fs, info.path, info.size)) is not None:
                    yield fs, info.path, info.size, identity
            except FileNotFoundError:
                pass                       # renamed since it was listed; its new name comes with the next batch


def _check(fs: pafs.FileSystem, path: str, pos: int) -> int:
    return zlib.crc32(_bytes(fs, path, max(0, pos - CHECKED), pos))


def _line_end(fs: pafs.FileSystem, path: str, start: int, size: int, limit: int | None) -> tuple[int, int]:
    """(end of the last complete line, lines) from ``start`` on, of at most ``limit`` lines;
    without a limit lines aren't counted."""
    if limit is None:
        end = size
        while end > start:
            from_ = max(start, end - CHUNK)
            k = _bytes(fs, path, from_, end).rfind(b"\n")
            if k >= 0:
                return from_ + k + 1, 0
            end = from_
        return start, 0
    end, lines, at = start, 0, start
    while at < size and lines < limit:
        part = _bytes(fs, path, at, min(size, at + CHUNK))
        n = part.count(b"\n")
        if lines + n <= limit:
            k = part.rfind(b"\n")
        else:
            k = -1
            for _ in range(limit - lines):
                k = part.index(b"\n", k + 1)
            n = limit - lines
        if k >= 0:
            end, lines = at + k + 1, lines + n
        at += len(part)
    return end, lines


class Part(InputPartition):
    def __init__(self, source: str, pattern: str, path: str, name: str, begin: int, start: int, end: int, stop: int):
        self.source, self.pattern, self.path, self.name = source, pattern, path, name
        self.begin, self.start, self.end, self.stop = begin, start, end, stop


class GrowingLogsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns: dict[str, str] = json.loads(options["sources"])
        self.max_lines = int(options["max_lines"]) if options.get("max_lines") else None
        self.part_bytes = int(options.get("part_bytes", 64 << 20))
        self.hold: str | None = options.get("hold") or None
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _held(self) -> bool:
        if self.hold is None:
            return False
        fs, path = _open(self.hold)
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def latestOffset(self) -> dict:
        """Per source and file: path, position, check sum of what is before it."""
        while True:
            if not self._held():
                new = self._found()
                if not self._held():          # otherwise some of the files may have grown, others not yet
                    self.at = new
            if self.at is not None:
                return self.at
            time.sleep(0.05)                  # where an earlier run ended isn't known yet

    def _found(self) -> dict:
        old, new, left = self.at or {}, {}, self.max_lines
        for source, pattern in self.patterns.items():
            known, files = old.get(source, {}), {}
            for fs, path, size, identity in _files(pattern):
                times, pos = 0, 0
                for name, f in known.items():
                    if name.rpartition("#")[0] == identity:
                        times, pos = int(name.rpartition("#")[2]), f["pos"]
                        if size < pos or _check(fs, path, pos) != f["check"]:
                            times, pos = times + 1, 0
                end, lines = (pos, 0) if left == 0 else _line_end(fs, path, pos, size, left)
                left = None if left is None else left - lines
                files[f"{identity}#{times}"] = {"path": path if isinstance(fs, pafs.LocalFileSystem) else self._uri(pattern, path),
                                                "pos": end, "check": _check(fs, path, end)}
            new[source] = files
        return new

    @staticmethod
    def _uri(pattern: str, path: str) -> str:
        return posixpath.join(posixpath.dirname(pattern), posixpath.basename(path))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if self.at is None:           # after a restart the first call is for the last batch that was planned
            self.at = end
        parts = []
        for source, files in end.items():
            for name, f in files.items():
                begin = start.get(source, {}).get(name, {"pos": 0})["pos"]
                for a in range(begin, f["pos"], self.part_bytes):
                    parts.append(Part(source, self.patterns[source], f["path"], name, begin, a, min(f["pos"], a + self.part_bytes), f["pos"]))
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        identity = part.name.rpartition("#")[0]
        fs, path = _open(part.path)
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File or _identity(fs, path, info.size) != identity:     # renamed since
            path = next((p for _, p, _, i in _files(part.pattern) if i == identity), None)
            if path is None:
                raise FileNotFoundError(f"{part.path} is gone with bytes {part.start} to {part.end} unread")
        with fs.open_input_file(path) as f:
            pos = part.start
            if pos > part.begin:                  # the line that is under way belongs to the part before
                pos = self._next_line(f, pos - 1, part.stop)
            while pos < part.end:
                data = f.read_at(min(CHUNK, part.stop - pos), pos)
                k = data.rfind(b"\n")
                while k < 0 and pos + len(data) < part.stop:
                    data += f.read_at(min(CHUNK, part.stop - pos - len(data)), pos + len(data))
                    k = data.rfind(b"\n")
                lines, starts, at = [], [], 0
                for line in data[:k].split(b"\n"):
                    if pos + at >= part.end:
                        break
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    starts.append(pos + at)
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([part.source] * len(lines)),
                                                  pa.array([part.name] * len(lines)), pa.array(starts, pa.int64())], names=["value", "source", "file", "pos"])
                pos += at

    @staticmethod
    def _next_line(f, pos: int, stop: int) -> int:
        while pos < stop:
            data = f.read_at(min(CHUNK, stop - pos), pos)
            k = data.find(b"\n")
            if k >= 0:
                return pos + k + 1
            pos += len(data)
        return stop


class GrowingLogsBatch(DataSourceReader):
    """What a stream that starts now would read, as a batch."""

    def __init__(self, options: dict):
        self.stream = GrowingLogsReader({**options, "max_lines": ""})

    def partitions(self) -> list[Part]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.stream.read(part)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GrowingLogsBatch:
        return GrowingLogsBatch(self.options)

    def streamReader(self, schema) -> GrowingLogsReader:
        return GrowingLogsReader(self.options)


def _with_ids(lines: DataFrame) -> DataFrame:
    return (lines.withColumn("ingest_time", F.current_timestamp())
            .withColumn("event_id", F.xxhash64("source", "file", "pos")).select("value", "source", "ingest_time", "event_id"))


def read_growing(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """The complete lines that the files hold now, with the ids that the stream gives them."""
    spark.dataSource.register(GrowingLogs)
    return _with_ids(spark.read.format(FORMAT).option("sources", json.dumps(patterns)).load())


def tail_sources(spark: SparkSession, patterns: dict[str, str], max_lines: int | None = None, part_bytes: int | None = None, hold: str | None = None) -> DataFrame:
    """Lines appended to the files that match each source's pattern, as a stream: value,
    source, ingest_time, event_id (of file and position: the same in every run). No batch
    takes lines while the file ``hold`` exists."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format(FORMAT).option("sources", json.dumps(patterns))
    for name, value in (("max_lines", max_lines), ("part_bytes", part_bytes), ("hold", hold)):
        if value is not None:
            reader = reader.option(name, value)
    return _with_ids(reader.load())
