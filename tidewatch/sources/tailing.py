"""Files that grow, as a stream: a data source whose offsets are the bytes read of each file.

Spark keeps the offsets in the query's checkpoint, so a restarted query goes on where it was, and a repeated micro-batch
reads the same bytes. Only whole lines are taken; a line that is still being written waits for its end.

A file is known by its inode (on local disks) and a checksum of its first bytes. When another file appears under its
path, as after log rotation, or when it got shorter, reading starts at its beginning. A rotated file that still matches
the pattern goes on under its new name where it was left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_files"
SCHEMA = "line string, path string, block bigint"
HEAD_BYTES = 256  # of a file that tell it from others
PART_BYTES = 64 << 20  # that one task reads
READ_BYTES = 4 << 20
NEWLINE = b"\n"


@dataclass
class Part(InputPartition):
    """The lines that begin in bytes [start, end) of a file; ``first`` is where the micro-batch begins in it."""

    path: str
    first: int
    start: int
    end: int


class Folder:
    """Files of one folder whose names match a pattern."""

    def __init__(self, path: str) -> None:
        top, self.pattern = path.rsplit("/", 1)
        self.files, self.top = fs.FileSystem.from_uri(top if "://" in top else f"file://{top}")

    def sizes(self) -> dict[str, int]:
        found = self.files.get_file_info(fs.FileSelector(self.top, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)}

    def read(self, path: str, start: int, size: int) -> bytes:
        with self.files.open_input_file(path) as file:
            file.seek(start)
            return file.read(size)

    def inode(self, path: str) -> int:
        return os.stat(path).st_ino if isinstance(self.files, fs.LocalFileSystem) else 0

    def last_line_end(self, path: str, size: int) -> int:
        """Bytes up to the end of the last whole line."""
        end = size
        while end > 0:
            start = max(0, end - READ_BYTES)
            at = self.read(path, start, end - start).rfind(NEWLINE)
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def state(self, path: str, size: int) -> dict[str, int]:
        head = self.read(path, 0, min(size, HEAD_BYTES))
        return {"inode": self.inode(path), "head": len(head), "crc": zlib.crc32(head), "end": self.last_line_end(path, size)}

    def is_file(self, path: str, state: dict[str, int]) -> bool:
        """Whether the file under ``path`` is the one that had this state, or has grown from it."""
        try:
            head = self.read(path, 0, state["head"])
            return self.inode(path) == state["inode"] and len(head) == state["head"] and zlib.crc32(head) == state["crc"]
        except OSError:
            return False


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict[str, Any]:
        return {}

    def latestOffset(self) -> dict[str, Any]:
        folder, out = Folder(self.path), {}
        for path, size in sorted(folder.sizes().items()):
            try:
                out[path] = folder.state(path, size)
            except OSError:  # moved away meanwhile
                continue
        return out

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[InputPartition]:
        folder = Folder(self.path)
        parts: list[InputPartition] = []
        for path, state in end.items():
            now = path
            if not folder.is_file(now, state):  # a repeated batch after the file was moved
                now = next((p for p in folder.sizes() if folder.is_file(p, state)), "")
            if not now:
                continue
            before = [path, *(p for p in start if p != path)]
            read = next((start[p]["end"] for p in before if p in start and folder.is_file(now, start[p])), 0)
            if read > state["end"]:
                read = 0  # cut short and written anew
            cuts = [*range(read, state["end"], PART_BYTES), state["end"]]
            parts += [Part(now, read, a, b) for a, b in zip(cuts, cuts[1:])]
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Part)
        with Folder(self.path).files.open_input_file(partition.path) as file:
            at = partition.start
            if at > partition.first:  # the line that reaches in belongs to the part before
                at -= 1
                file.seek(at)
                while chunk := file.read(READ_BYTES):
                    found = chunk.find(NEWLINE)
                    at += len(chunk) if found < 0 else found + 1
                    if found >= 0:
                        break
            file.seek(at)
            held = b""
            while at < partition.end:
                chunk = file.read(READ_BYTES)
                if not chunk:
                    return
                lines = (held + chunk).split(NEWLINE)
                held = lines.pop()
                whole = []
                for line in lines:
                    if at >= partition.end:
                        break
                    whole.append(line.decode("utf-8", "replace").rstrip("\r"))
                    at += len(line) + 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "line": pa.array(whole, pa.string()),
                        "path": pa.array([partition.path] * len(whole), pa.string()),
                        "block": pa.array([partition.start] * len(whole), pa.int64()),
                    }
                )


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return GrowingFilesReader(self.options["path"])


def stream_growing_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines (path, block, line) of the files that match ``path`` (a folder and a pattern for names, as ``/logs/*.log``)
    as they are written, for :func:`tidewatch.streaming.ingest.write_logs`."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(NAME).option("path", path).load()
