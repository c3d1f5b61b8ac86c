"""A streaming source that follows growing text files: each line is given once, however often its file is appended to.

A stream's offset has, for each file, the byte up to which lines were read, and the file's first bytes, by which a file that was
truncated or replaced is known and read anew. Spark commits offsets with the checkpoint, so a stream that is stopped or loses an executor goes on
where it was.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 64
BLOCK = 1 << 20
#: New bytes of one file that one task reads.
PIECE_BYTES = 64 << 20


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder: local paths and what Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "/", folder))


class _Range(InputPartition):
    """Lines of a file that begin in [first, last); `low` and `high` are the ends of lines around all new ones."""

    def __init__(self, path: str, low: int, first: int, last: int, high: int):
        self.path, self.low, self.first, self.last, self.high = path, low, first, last, high


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, piece_bytes: int):
        self.folder, self.pattern, self.piece_bytes = folder, pattern, piece_bytes
        self.known: dict[str, tuple[int, object, list]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where the last whole line of each file ends now. Files that have not changed since the last look are not opened."""
        fs, root = store(self.folder)
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != pafs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern) or info.base_name[0] in "._":
                continue
            known = self.known.get(info.path)
            if not known or known[:2] != (info.size, info.mtime_ns):
                with fs.open_input_file(info.path) as f:
                    known = self.known[info.path] = (info.size, info.mtime_ns, _ends(f, info.size))
            out[info.path] = known[2]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, (high, head) in end.items():
            before, old = start.get(path, (0, ""))
            low = before if before <= high and head.startswith(old) else 0
            parts += [_Range(path, low, at, min(at + self.piece_bytes, high), high) for at in range(low, high, self.piece_bytes)]
        return parts

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.folder)
        with fs.open_input_file(partition.path) as f:
            # a line belongs to the piece in which it begins, so one that began before is passed over
            at = partition.first - (partition.first > partition.low)
            f.seek(at)
            rest, skip, rows = b"", at < partition.first, []
            while at < partition.last:
                block = f.read(min(BLOCK, partition.high - at - len(rest)))
                if not block:
                    break
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < partition.last:
                        rows.append((at, line))
                    at += len(line) + 1
                if rows:
                    yield _batch(partition.path, rows)
                    rows = []

    def commit(self, end: dict) -> None:
        pass


def _ends(f, size: int) -> list:
    """[end of the last whole line, the first bytes as hexadecimal digits] of an open file."""
    end, at = 0, size
    while at > 0 and not end:
        low = max(0, at - BLOCK)
        found = f.read_at(at - low, low).rfind(b"\n")
        end, at = low + found + 1 if found >= 0 else 0, low
    return [end, f.read_at(min(HEAD_BYTES, end), 0).hex()]


def _batch(path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    at, lines = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines])], names=["path", "at", "line"])


class LogTail(DataSource):
    """Options: path (a folder), pattern (of file names, default *), piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("piece_bytes", PIECE_BYTES)))


def follow(spark: SparkSession, folder: str, pattern: str = "*", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A stream of (path, at, line): whole lines of the files below a folder, each once, with the byte at which it begins.

    A line without its end waits for it. A file that became shorter, or whose first bytes changed, is read from its start. Files and
    folders may appear and go at any time; names that begin with a dot or an underscore are passed over.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("pattern", pattern).option("piece_bytes", piece_bytes).load(folder)
