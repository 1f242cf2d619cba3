"""A stream of the lines of files that grow: how far each file has been read is the stream's offset, so a restart goes on where the
last commit stood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file in a task's range, and those looked at in one step for the last line end.
SPLIT_BYTES, STEP_BYTES = 32 << 20, 1 << 16
LINES_PER_BATCH = 4096
SCHEMA = "path string, at long, value string"


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    end: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(file, begin: int, size: int) -> int:
    """Where the last whole line ends in the bytes from `begin`, itself a line's begin, up to `size`."""
    end = size
    while end > begin:
        start = max(begin, end - STEP_BYTES)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return begin


def lines(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range of bytes; one that begins there is read to its end."""
    at = begin
    if begin:  # a line that begins before belongs to the range before
        file.seek(begin - 1)
        at = begin - 1
    else:
        file.seek(0)
    held, skip = b"", begin > 0
    while held or at < end:
        data = file.read(STEP_BYTES)
        if not data:
            break
        place, at = at - len(held), at + len(data)
        *whole, held = (held + data).split(b"\n")
        for line in whole:
            if not skip:
                if place >= end:
                    return
                yield place, line
            place, skip = place + len(line) + 1, False
        if place >= end:
            return


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, split_bytes: int, schema: pa.Schema):
        self.path, self.suffix, self.split_bytes, self.schema = path, suffix, split_bytes, schema
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Files of the folder by name, each with where its last whole line ends. A file that became shorter is an error."""
        store, top = _located(self.path)
        out = {}
        for info in sorted(store.get_file_info(fs.FileSelector(top, allow_not_found=True)), key=lambda i: i.base_name):
            if not info.is_file or info.base_name[0] in "._" or not info.base_name.endswith(self.suffix):
                continue
            before = self.seen.get(info.base_name, 0)
            if info.size < before:
                raise ValueError(f"{info.path} is shorter than what was read of it")
            with store.open_input_file(info.path) as f:
                out[info.base_name] = self.seen[info.base_name] = whole_lines(f, before, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for name, to in end.items():
            begin = start.get(name, 0)
            out += [_Part(f"{self.path.rstrip('/')}/{name}", a, min(to, a + self.split_bytes)) for a in range(begin, to, self.split_bytes)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, at = _located(partition.path)
        rows: list[tuple[int, str]] = []
        with store.open_input_file(at) as f:
            for place, line in lines(f, partition.begin, partition.end):
                rows.append((place, line.decode("utf-8", "replace")))
                if len(rows) == LINES_PER_BATCH:
                    yield self._batch(partition.path, rows)
                    rows = []
        if rows:
            yield self._batch(partition.path, rows)

    def _batch(self, path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())], schema=self.schema)


class TailSource(DataSource):
    """Options: path (a folder), suffix, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("split_bytes", SPLIT_BYTES)), to_arrow_schema(schema))


def tail_lines(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream (path, at, value) of the lines of a folder's files, those to come too: a line is given once, when its line end is written."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("line_tail").options(suffix=suffix, split_bytes=str(split_bytes)).load(path)


def tail_sam(spark: SparkSession, path: str, suffix: str = ".sam", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of the reads of alignment text files that grow: the columns of a read but file_id, and path; row_id is a line's place in its
    file in bytes."""
    from readloom.sources.text import reads_of_lines

    found = tail_lines(spark, path, suffix, split_bytes)
    return reads_of_lines(found.withColumn("line_no", F.col("at")).withColumn("file_id", F.lit(0)), "path").drop("file_id")
