"""A data source of text lines in files that grow: read in ranges of bytes, or followed as a stream.

Spark's own file source takes a file once; what is appended to it later is not seen. This one keeps, as its offset, how
far each file has been read, so an event log can be followed while it is written. A range ends at a line's end; a last
line without its break is left until it has one (a batch read takes it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import LOG, zero_values

#: Bytes of a range; one longer line is a range of its own.
RANGE_BYTES = 32 << 20
_STEP = 1 << 16
SCHEMA = "file string, at long, value string"


class Range(InputPartition):
    """Bytes start to end of a file; a range begins behind a line's end, or else behind the next one after its start."""

    def __init__(self, path: str, start: int, end: int, exact: bool) -> None:
        self.path, self.start, self.end, self.exact = path, start, end, exact


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(folder: str, suffix: str) -> dict[str, int]:
    """Bytes of each file of a folder, or of one file, by path."""
    system, root = _system(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else [system.get_file_info(root)]
    return {x.path: x.size for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not x.base_name.startswith((".", "_"))}


def _whole_lines(system: fs.FileSystem, path: str, start: int, size: int) -> int:
    """Where the last whole line behind start ends."""
    with system.open_input_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - _STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def _lines(folder: str, r: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, a batch a step."""
    system, _ = _system(folder)
    with system.open_input_file(r.path) as f:
        size = f.size()
        at = r.start
        if not r.exact and at:  # the line that the range cuts belongs to the range before
            at -= 1
            f.seek(at)
            while chunk := f.read(_STEP):
                k = chunk.find(b"\n")
                at += len(chunk) if k < 0 else k + 1
                if k >= 0:
                    break
        f.seek(at)
        rest, places, values = b"", [], []
        while at < r.end or rest:
            chunk = f.read(_STEP)
            data = rest + chunk
            *whole, rest = data.split(b"\n")
            if not chunk:  # the file's end
                whole, rest = ([rest] if rest else []), b""
            for line in whole:
                if at >= r.end:
                    rest = b""
                    break
                places.append(at)
                values.append(line.decode("utf-8", "replace"))
                at += len(line) + 1
            if at >= r.end:
                rest = b""
            if places and (len(places) > 4096 or at >= r.end or not chunk):
                yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(places)), pa.array(places, pa.int64()), pa.array(values)], ["file", "at", "value"])
                places, values = [], []
            if not chunk or at >= size:
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(places)), pa.array(places, pa.int64()), pa.array(values)], ["file", "at", "value"])
                return


def _cut(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, s, min(s + size, end), s == start) for s in range(start, end, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return [r for path, n in sorted(_files(self.folder, self.suffix).items()) for r in _cut(path, 0, n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)


class _Follower(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _system(self.folder)
        self.known = {p: _whole_lines(system, p, self.known.get(p, 0), n) for p, n in _files(self.folder, self.suffix).items()}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, n in sorted(end.items()) for r in _cut(path, start.get(path, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format growing_lines. Options: path (a folder or file), suffix (of file names), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower({k.lower(): v for k, v in self.options.items()})


def read_lines(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """(file, at, value): the lines of a folder's files and the bytes at which they begin."""
    spark.dataSource.register(GrowingLines)
    return (spark.readStream if stream else spark.read).format("growing_lines").options(path=path, **options).load()


def log_entries(lines: DataFrame) -> DataFrame:
    """Log entries of lines, absent fields as zero values; lines that are no JSON object are left out."""
    parsed = lines.withColumn("e", F.from_json("value", LOG, {"mode": "PERMISSIVE"})).filter(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    return zero_values(parsed.select("file", "at", "e.*"))
