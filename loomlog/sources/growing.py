"""A stream of the lines of files that are still being written.

The offset of the stream is the size of every file at a listing. A line belongs to the batch in
which its line end lies, so half a last line waits, a batch that is run again gives the same
lines, and planning reads no file: a task looks back for the start of its first line.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "value string, file string"
BLOCK = 1 << 20
SPLIT_BYTES = 64 << 20  # a task's share of what one file has grown by

# the workers may lack this package: they are sent the classes themselves
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, from_end: bool, split: int):
        self.path, self.pattern, self.from_end, self.split = path, pattern, from_end, split

    def _sizes(self) -> dict[str, int]:
        files, root = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return {f.path: f.size for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and f.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return self._sizes() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, size in end.items():
            done = start.get(file, 0)
            if done > size:  # cut short or begun anew
                done = 0
            out += [Range(file, at, min(at + self.split, size)) for at in range(done, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        with files.open_input_file(partition.file) as f:
            rest = _before(f, partition.start)
            at = partition.start
            while at < partition.end:
                data = f.read_at(min(BLOCK, partition.end - at), at)
                if not data:  # cut short since the batch was planned
                    return
                at += len(data)
                *lines, last = data.split(b"\n")
                if lines:
                    lines[0] = b"".join([*rest, lines[0]])
                    rest = [last]
                    texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([partition.file] * len(texts), pa.string())], ["value", "file"])
                else:
                    rest.append(last)


def _before(f: pa.NativeFile, at: int) -> list[bytes]:
    """The part before ``at`` of the line that ``at`` lies in, in pieces."""
    pieces: list[bytes] = []
    while at > 0:
        lo = max(0, at - BLOCK)
        data = f.read_at(at - lo, lo)
        cut = data.rfind(b"\n")
        pieces.insert(0, data[cut + 1 :])
        if cut >= 0:
            break
        at = lo
    return pieces


class GrowingLines(DataSource):
    """Options: path, pattern (of file names, ``*``), from_end (only lines that end after the start), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        told = self.options
        return _Reader(
            told["path"].rstrip("/"), told.get("pattern", "*"), told.get("from_end", "false").lower() == "true",
            int(told.get("split_bytes", SPLIT_BYTES)),
        )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
