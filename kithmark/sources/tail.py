"""Lines of growing files as a stream: ``spark.readStream.format("line_tail").load(folder)``.

The stream's position is a byte offset for each file, kept in the query's checkpoint. A batch goes as far as the last line end that a file has,
so a line that is being written is held back until it is whole. A file that has `<name>.done` beside it is finished: its last line counts
without a line end as well. Long stretches of a file are cut between tasks; a line belongs to the task in whose part it begins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that a task reads at most, and bytes that are searched for a line end at a time.
PART, STEP = 64 << 20, 1 << 16


@dataclass
class Stretch(InputPartition):
    """Bytes `start` to `stop` of a file, and whether a line begins at `start`."""

    path: str
    start: int
    stop: int
    end: int
    whole: bool


class LineTail(DataSource):
    """Options: path (a folder, or a URI that Arrow's file systems know), suffix (of the files, default .jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema):
        return LineTailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


class LineTailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def _files(self):
        system, base = located(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return system, {f.base_name: f for f in found if f.type == fs.FileType.File}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        system, files = self._files()
        out = {}
        for name, f in files.items():
            if name.endswith(self.suffix):
                out[name] = f.size if f"{name}.done" in files else last_line_end(system, f.path, f.size)
        return {name: n for name, n in sorted(out.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, n in end.items():
            first = start.get(name, 0)
            for at in range(first, n, PART):
                out.append(Stretch(f"{self.path.rstrip('/')}/{name}", at, min(at + PART, n), n, at == first))
        return out or [Stretch("", 0, 0, 0, True)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        if not partition.path:
            return
        system, path = located(partition.path)
        name = path.rsplit("/", 1)[-1]
        with system.open_input_file(path) as f:
            # A part that begins inside a line leaves that line to the part before; a line at the end is read to its own end.
            at = partition.start if partition.whole else line_start(f, partition.start, partition.end)
            for position, line in lines(f, at, partition.stop, partition.end):
                yield name, position, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def last_line_end(system, path: str, size: int) -> int:
    """The byte behind the last line end of a file; 0 if it has none."""
    with system.open_input_file(path) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - STEP)
            found = f.read_at(stop - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return 0


def line_start(f, at: int, end: int) -> int:
    """Where the first line that begins at `at` or later begins."""
    at -= 1
    while at < end:
        chunk = f.read_at(min(STEP, end - at), at)
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(chunk)
    return end


def lines(f, at: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin from `at` up to `stop`, without their line ends; none of them goes beyond `end`."""
    held, pos, read = b"", 0, at
    while at < stop:
        cut = held.find(b"\n", pos)
        if cut < 0 and read < end:
            more = f.read_at(min(16 * STEP, end - read), read)
            held, pos, read = held[pos:] + more, 0, read + len(more)
            continue
        last = len(held) if cut < 0 else cut
        yield at, held[pos:last].removesuffix(b"\r")
        at, pos = at + last - pos + 1, last + 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTail)


def positions(offset: str) -> dict[str, int]:
    """A progress report's offset as file -> bytes."""
    return json.loads(offset)
