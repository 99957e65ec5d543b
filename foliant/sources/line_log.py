"""A data source for logs of lines that go on growing: ``spark.read`` and ``spark.readStream`` ``.format("line_log")``.

Options: ``path`` (a folder, searched with its subfolders) and ``split`` (bytes of one partition). A row is a line with
its file and the byte at which it begins. Files are cut into byte ranges, so one long file is read by many tasks; a
range takes the lines that begin in it. What a line means is left to the expressions of ``logs``.

On a stream the offset says how far each file was read, always up to the end of a line: a line that is still being
written waits for its end, and rows that are appended to a file that was read before are found, which a source of whole
files can not do. Offsets lie in the checkpoint, so a query that is started again goes on where it was. A file that is
shorter than before was replaced and is read from its start.

Filters on ``file`` are applied before any file is opened, and ``value LIKE '%x%'`` before a line leaves its task (this
needs ``spark.sql.python.filterPushdown.enabled``, which ``read_lines`` sets). Lines are UTF-8; bytes that are not become replacement marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPLIT = 64 << 20
_BLOCK = 1 << 20
_ROWS = 10_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+://", path) else re.sub(r"^(file:)?/+", "file:///", path))


def _files(path: str) -> dict[str, int]:
    store, place = _store(path)
    found = store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


def _whole_lines(path: str, file: str, size: int) -> int:
    """Where the last whole line of a file ends."""
    store, _ = _store(path)
    with store.open_input_file(file) as f:
        hi = size
        while hi > 0:
            lo = max(0, hi - _BLOCK)
            f.seek(lo)
            at = f.read(hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return 0


@dataclass
class Range(InputPartition):
    """The lines of ``file`` that begin in ``[start, end)``; lines end before ``stop``. ``first`` begins a line for certain."""

    file: str
    start: int
    end: int
    stop: int
    first: bool


def _ranges(file: str, lo: int, hi: int, split: int) -> list[Range]:
    return [Range(file, at, min(at + split, hi), hi, at == lo) for at in range(lo, hi, split)]


def _lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    store, _ = _store(path)
    with store.open_input_file(part.file) as f:
        at = part.start if part.first else part.start - 1  # a line begins here if the byte before ends one
        f.seek(at)
        rest, skip = b"", not part.first
        while at < part.end or rest:
            more = f.read(min(_BLOCK, part.stop - at - len(rest)))
            block = rest + more
            cut = block.split(b"\n")
            rest = cut.pop()
            for line in cut:
                if skip:
                    skip = False
                elif at < part.end:
                    yield at, line
                else:
                    return
                at += len(line) + 1
            if not more:
                if rest and not skip and at < part.end:
                    yield at, rest  # the last line of a file that does not end with a line end
                return


def _batches(path: str, part: Range, contains: list[str]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        text = [line.decode("utf-8", "replace").removesuffix("\r") for line in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([part.file] * len(held), pa.string()), pa.array(places, pa.int64()), pa.array(text, pa.string())], names=["file", "at", "value"])

    needles = [c.encode() for c in contains]
    held: list[bytes] = []
    places: list[int] = []
    for at, line in _lines(path, part):
        if all(n in line for n in needles):
            held.append(line)
            places.append(at)
        if len(held) == _ROWS:
            yield batch()
            held, places = [], []
    if held:
        yield batch()


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.only: set[str] | None = None
        self.contains: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("file",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif isinstance(f, StringContains) and f.attribute == ("value",):
                self.contains.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        kept = {f: n for f, n in _files(self.path).items() if self.only is None or f in self.only}
        return [r for f, n in sorted(kept.items()) for r in _ranges(f, 0, n, self.split)] or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _batches(self.path, partition, self.contains)


class LineStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.known: dict[str, tuple[int, int]] = {}  # file -> (size, end of its last whole line)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in _files(self.path).items():
            if self.known.get(file, (-1, 0))[0] != size:
                self.known[file] = size, _whole_lines(self.path, file, size)
        return {f: end for f, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, hi in sorted(end.items()):
            lo = start.get(file, 0)
            out += _ranges(file, lo if lo <= hi else 0, hi, self.split)
        return out or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _batches(self.path, partition, [])

    def commit(self, end: dict) -> None:
        pass


class LineLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), StructField("at", LongType()), StructField("value", StringType())])

    def _split(self) -> int:
        return max(1, int(self.options.get("split", SPLIT)))

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], self._split())

    def streamReader(self, schema: StructType) -> LineStreamReader:
        return LineStreamReader(self.options["path"], self._split())


def read_lines(spark: SparkSession, path: str, stream: bool = False, split: int = SPLIT) -> DataFrame:
    """(file, at, value) of the lines below ``path``, as a table or a stream."""
    spark.dataSource.register(LineLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.readStream if stream else spark.read
    return reader.format("line_log").option("split", split).load(path)
