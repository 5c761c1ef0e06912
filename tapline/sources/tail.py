"""Live sensor logs: a streaming source that follows files while they grow, rotate and are cut."""

from __future__ import annotations

import mmap
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .zeek import decode_lines, parse_fields

# Fixed value: the live reader refuses longer lines; readers of finished files take any.
MAX_LINE_CHARS = 1_048_576
HEAD = 256  # first bytes of a file that tell whether it is still the same
STEP = 65_536
ROWS = 4_096
GENERATION_BITS = 48  # arrival_seq: generation of the file within a batch, then the byte offset

SCHEMA = "source_file string, source_path string, byte_offset long, arrival_seq long, header binary, content binary, zeek_available_at timestamp"


@dataclass(frozen=True)
class FileState:
    """Where a file was read up to: the end of its last whole line, and a checksum of its first bytes."""

    name: str
    upto: int
    head: int
    mark: int

    @classmethod
    def of(cls, path: str) -> FileState:
        upto = last_line_end(path)
        head = min(upto, HEAD)
        return cls(os.path.basename(path), upto, head, head_mark(path, head))

    def follows(self, before: FileState, path: str) -> bool:
        """Whether the file still starts as before and has not become shorter."""
        return self.upto >= before.upto and head_mark(path, before.head) == before.mark


def last_line_end(path: str) -> int:
    """Bytes up to and with the last line feed."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - STEP)
            file.seek(start)
            found = file.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def head_mark(path: str, size: int) -> int:
    with open(path, "rb") as file:
        return zlib.crc32(file.read(size))


def header_above(path: str, offset: int) -> bytes | None:
    """The last ``#fields`` line that ends at or before an offset; files that do not open with # have none."""
    with open(path, "rb") as file:
        if not offset or file.read(1) != b"#":
            return None
        with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as view:
            at = view.rfind(b"\n#fields", 0, offset)
            at = at + 1 if at >= 0 else 0
            line = view[at : view.find(b"\n", at)]
    return line.rstrip(b"\r") if line.startswith(b"#fields") else None


@dataclass
class Range(InputPartition):
    path: str
    identity: str
    name: str
    start: int
    end: int
    generation: int


class TailReader(DataSourceStreamReader):
    """Offsets are, for every followed file, its identity, name and the end of its last whole line.

    Identity is device and inode, so a rotated file is followed under its new name in the same folder until it is read.
    A file that became shorter, or starts otherwise, is read from its start. Only whole lines are
    taken; what follows the last line feed waits. Nothing is kept in memory between batches.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.names = [n.strip() for n in options.get("names", "conn.log,dns.log,ssl.log,tls.log,packet.log").split(",")]
        self.from_start = options.get("start", "end") == "beginning"

    def _is_followed(self, name: str) -> bool:
        return any(name == n or name.startswith((n + ".", n + "-", n.rsplit(".", 1)[0] + ".", n.rsplit(".", 1)[0] + "-")) for n in self.names)

    def _paths(self) -> dict[str, str]:
        """Paths of the log files and their rotated siblings by identity."""
        found = {}
        with os.scandir(self.folder) as entries:
            for entry in entries:
                if self._is_followed(entry.name) and entry.is_file(follow_symlinks=False) and not entry.name.endswith((".gz", ".zst", ".bz2")):
                    stat = entry.stat()
                    found[f"{stat.st_dev}:{stat.st_ino}"] = entry.path
        return found

    def _states(self) -> dict[str, FileState]:
        found = {}
        for identity, path in self._paths().items():
            try:
                found[identity] = FileState.of(path)
            except OSError:
                continue
        return found

    def initialOffset(self) -> dict:
        return {} if self.from_start else self.latestOffset()

    def latestOffset(self) -> dict:
        return {k: [s.name, s.upto, s.head, s.mark] for k, s in sorted(self._states().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        paths, ranges = self._paths(), []
        for identity, fields in end.items():
            path, now = paths.get(identity), FileState(*fields)
            if path is None:
                continue
            before = FileState(*start[identity]) if identity in start else None
            if before is None and now.name not in self.names:
                continue  # a rotated file whose lines nobody was following, or a copy of one
            begin = before.upto if before is not None and now.follows(before, path) else 0
            if now.upto > begin:
                live = now.name if now.name in self.names else next(n for n in self.names if before.name == n or now.name.startswith(n.rsplit(".", 1)[0]))
                ranges.append(Range(path, identity, live, begin, now.upto, int(now.name in self.names)))
        return ranges or [Range("", "", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        path = partition.path
        if identity_of(path) != partition.identity:  # rotated since the batch was planned
            path = self._paths().get(partition.identity)
            if path is None:
                return
        header, rows = header_above(path, partition.start), []
        now = datetime.now(timezone.utc)
        with open(path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end and (line := file.readline()).endswith(b"\n"):
                body = line.rstrip(b"\n").removesuffix(b"\r")
                if body.startswith(b"#fields"):
                    header = body
                elif body and not body.startswith(b"#"):
                    rows.append((partition.name, path, at, partition.generation << GENERATION_BITS | at, header, body, now))
                at += len(line)
                if len(rows) == ROWS:
                    yield rows_of(rows)
                    rows = []
        if rows:
            yield rows_of(rows)


def identity_of(path: str) -> str | None:
    try:
        stat = os.stat(path)
    except OSError:
        return None
    return f"{stat.st_dev}:{stat.st_ino}"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.timestamp("us", tz="UTC")]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class SensorTail(DataSource):
    """Format ``sensor_tail``. Options: ``path`` (a folder that driver and executors reach), ``names`` (live file names,
    comma-separated), ``start`` (``end``: skip what is there at the first start; or ``beginning``)."""

    @classmethod
    def name(cls) -> str:
        return "sensor_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, folder: str, names: list[str], start: str = "end") -> DataFrame:
    """Streaming lines of live logs, each once: appended, rotated and truncated files are followed.

    A header or comment is no row; ``header`` is the last ``#fields`` line above a line in its file.
    """
    spark.dataSource.register(SensorTail)
    return spark.readStream.format("sensor_tail").options(path=folder, names=",".join(names), start=start).load()


def tail_records(spark: SparkSession, folder: str, names: list[str], start: str = "end") -> DataFrame:
    """Streaming raw records of live logs, as ``read_zeek`` gives them of finished ones, rejects included.

    Reasons name a line by ``@`` and its byte offset, as a growing file has no cheap line number. ``arrival_seq`` rises with
    the arrival of a file's lines within a micro-batch.
    """
    lines = tail_lines(spark, folder, names, start)
    fields = F.when(F.col("header").isNotNull(), parse_fields(F.col("header").cast("string")))
    place = F.concat(F.lit("@"), F.col("byte_offset").cast("string"))
    shaped = lines.select("source_file", "source_path", "byte_offset", "arrival_seq", "zeek_available_at", F.col("content").cast("string").alias("line"), fields.alias("fields"), place.alias("line_number"))
    return decode_lines(shaped, MAX_LINE_CHARS).drop("line_number")
