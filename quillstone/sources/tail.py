"""Log files as a source that goes on where it ended: by inode and byte offset.

    spark.dataSource.register(TailedLines)
    spark.readStream.format("tailed_lines").option("pattern", "/logs/app.log*").load()

A file is known by its inode, so a rotated file is read to its end under its new name, and the new file under
the old name from its start. A file that is shorter than its offset, or begins otherwise than it did (its first
bytes are kept as a checksum), was cut or replaced and is read from the start. Only whole lines are taken: a last line
without its line feed waits. What a copy-and-truncate rotation cuts off before it was seen is lost, as there is no
byte of it left. The files must be mounted on every executor. Bytes that are no UTF-8 become replacement signs.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes whose checksum tells a file from another with its inode; bytes of a task's range, and of one read.
HEAD, RANGE, BLOCK = 256, 64 << 20, 1 << 20
_SCHEMA = pa.schema([("path", pa.string()), ("inode", pa.int64()), ("start", pa.int64()), ("line", pa.string())])


def checksum(path: str, size: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(size))


def whole_lines(path: str, start: int, size: int) -> int:
    """Where the last line feed before `size` ends, or `start` if none is behind it: read backward by blocks."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - (64 << 10))
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class Range(InputPartition):
    """Lines that begin in bytes start to stop of a file."""

    def __init__(self, path: str, inode: int, start: int, stop: int, first: bool):
        self.path, self.inode, self.start, self.stop, self.first = path, inode, start, stop, first


def opened(part: Range, pattern: str):
    """The file of a range: by its path, or, if it was rotated meanwhile, by its inode."""
    for path in [part.path, *glob.glob(pattern)]:
        try:
            f = open(path, "rb")
        except OSError:
            continue
        if os.fstat(f.fileno()).st_ino == part.inode:
            return f
        f.close()
    raise FileNotFoundError(f"{part.path} (inode {part.inode}) has gone before it was read")


def lines_of(part: Range, pattern: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes]] = []
    with opened(part, pattern) as f:
        at = part.start
        if not part.first:  # the line that runs into this range belongs to the one before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        size = 0
        while at < part.stop:
            line = f.readline()
            if not line:
                break
            rows.append((at, line))
            at += len(line)
            size += len(line)
            if size >= BLOCK:
                yield _batch(part, rows)
                rows, size = [], 0
    if rows:
        yield _batch(part, rows)


def _batch(part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    text = [x.rstrip(b"\r\n").decode("utf-8", "replace") for _, x in rows]
    return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.inode] * n, pa.int64()), pa.array([a for a, _ in rows], pa.int64()), pa.array(text)], schema=_SCHEMA)


def look(pattern: str, known: dict, start: dict | None = None) -> dict:
    """Offsets by inode: path, generation, end of the whole lines, size and checksum of the head. `known` is the last
    offset; files that have gone leave it."""
    found = {}
    for path in sorted(glob.glob(pattern)):
        try:
            stat = os.stat(path)
            old = known.get(str(stat.st_ino))
            same = old is not None and stat.st_size >= old["end"] and checksum(path, old["head"]) == old["sum"]
            begin = old["end"] if same else 0
            head = old["head"] if same and old["head"] >= HEAD else min(HEAD, stat.st_size)
            end = whole_lines(path, begin, stat.st_size)
            generation = 0 if old is None else old["generation"] + (not same)
            found[str(stat.st_ino)] = {"path": path, "generation": generation, "end": end, "head": head, "sum": checksum(path, head)}
        except OSError:  # it goes just now; its new name, or the next look, finds it
            continue
    return found


def ranges(start: dict, end: dict) -> list[Range]:
    out = []
    for inode, new in end.items():
        old = start.get(inode)
        begin = old["end"] if old and old["generation"] == new["generation"] else 0
        for at in range(begin, new["end"], RANGE):
            out.append(Range(new["path"], int(inode), at, min(at + RANGE, new["end"]), at == begin))
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern, self.seen = pattern, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = look(self.pattern, self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = self.seen or end  # after a restart, generations go on from the last batch
        return ranges(start, end)

    def commit(self, end: dict) -> None:
        self.seen = self.seen or end

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(partition, self.pattern)


class WholeReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[Range]:
        return ranges({}, look(self.pattern, {})) or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(partition, self.pattern) if partition.stop else iter(())


class TailedLines(DataSource):
    """path, inode, start (the line's first byte), line."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return "path string, inode bigint, start bigint, line string"

    def reader(self, schema) -> WholeReader:
        return WholeReader(self.options["pattern"])

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["pattern"])
