"""A streaming source that tails growing files: exactly the new, complete lines since the last offset of each file."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads of a file, and bytes looked at in one go for the last end of a line.
RANGE, BACK = 32 << 20, 1 << 16


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", "/logs/*.log"): (value, source_file).

    The path must be one that driver and executors share. A file that shrank was rotated and is read from its start. A last
    line without its end waits for more.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, source_file string"

    def streamReader(self, schema):
        return TailReader(self.options["path"])


@dataclass
class Range(InputPartition):
    """The lines of a file that start within [start, stop); ``first`` tells that a line starts at ``start`` for sure."""

    path: str
    start: int
    stop: int
    first: bool


def last_line_end(path: str) -> int:
    """Where the last complete line of a file ends; looks at the file's end only."""
    at = os.path.getsize(path)
    with open(path, "rb") as f:
        while at > 0:
            start = max(0, at - BACK)
            f.seek(start)
            if (k := f.read(at - start).rfind(b"\n")) >= 0:
                return start + k + 1
            at = start
    return 0


class TailReader(DataSourceStreamReader):
    """The driver only lists files and looks for the end of the last line; executors read, in ranges."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        return {path: last_line_end(path) for path in sorted(glob.glob(self.pattern))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = int(start.get(path, 0))
            begin = 0 if stop < begin else begin
            out += [Range(path, at, min(at + RANGE, stop), at == begin) for at in range(begin, stop, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, str]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start if partition.first else partition.start - 1)
            if not partition.first:
                f.readline()  # a line that starts before belongs to the range before
            while f.tell() < partition.stop and (line := f.readline()):
                yield line.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace"), partition.path
