"""FASTA as a data source of Spark, read by ranges of bytes: pieces of bases that are then cut into chunks by running offsets, so
no task and no cell holds a contig, however its lines are broken."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.operators import ordered
from readloom.operators.pileup import CHUNK

#: Bytes of a file in a task's range, and of a piece of bases.
SPLIT_BYTES, PIECE_BYTES = 32 << 20, 1 << 16
#: A header line is no longer than this.
HEADER_BYTES = 1 << 20
PIECES = "file_id int, at long, name string, bases string"
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass
class _Part(InputPartition):
    file_id: int
    path: str
    begin: int
    end: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file, or those of a folder by name."""
    store, at = _located(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.base_name[0] not in "._"]
    return [f"{path.rstrip('/')}/{x}" for x in sorted(found)]


def pieces(file, begin: int, end: int) -> Iterator[tuple[int, str | None, str]]:
    """(place, name, bases) of the bytes from `begin` up to `end` of an open file: a header line that begins there gives a name and no bases,
    and is read to its end; the rest gives bases, upper case. `end` below 0 is the file's end."""
    file.seek(begin)
    at, inside = begin, False  # inside: of a header line
    if begin:
        back = min(begin, HEADER_BYTES)
        file.seek(begin - back)
        before = file.read(back)
        line = before[before.rfind(b"\n") + 1 :]
        inside = line.startswith(b">") and (len(line) < back or back == begin)
        fresh = before.endswith(b"\n")  # a line begins here
    else:
        fresh = True
    held = b""  # of a header that is not whole yet
    while end < 0 or at < end or held:
        want = PIECE_BYTES if end < 0 or held or at + PIECE_BYTES <= end else end - at
        data = file.read(want)
        if not data:
            break
        place, at = at - len(held), at + len(data)
        data, held = held + data, b""
        k, limit = 0, len(data) if end < 0 else min(len(data), end - place)
        if inside:  # the header belongs to the range before
            k = data.find(b"\n") + 1
            if not k:
                continue
            inside, fresh = False, True
        while k < limit:
            head = k if fresh and data[k : k + 1] == b">" else data.find(b"\n>", k) + 1 or len(data)
            stop = min(head, limit)
            if stop > k:
                bases = data[k:stop].translate(None, _SPACE)
                if bases:
                    yield place + k, None, bases.decode("latin-1").upper()
                fresh = data[stop - 1 : stop] == b"\n"
            if head >= limit:
                break
            k = data.find(b"\n", head) + 1
            if not k:
                held, fresh = data[head:], True
                break
            yield place + head, _name(data[head : k - 1]), ""
            fresh = True
    if held:
        yield at - len(held), _name(held), ""


def _name(line: bytes) -> str:
    """A header's name, which ends at the first white space."""
    words = line[1:].decode("utf-8", "replace").split()
    return words[0] if words else ""


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema, split_bytes: int):
        self.paths, self.schema, self.split_bytes = paths, schema, split_bytes

    def partitions(self) -> list[_Part]:
        out = []
        for i, path in enumerate(p for given in self.paths for p in _files(given)):
            store, at = _located(path)
            size = store.get_file_info(at).size
            if path.endswith(".gz"):
                out.append(_Part(i, path, 0, -1))
            else:
                out += [_Part(i, path, a, min(size, a + self.split_bytes)) for a in range(0, max(1, size), self.split_bytes)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, at = _located(partition.path)
        with store.open_input_file(at) as file:
            source = gzip.open(file) if partition.end < 0 else file
            rows: list[tuple] = []
            for row in pieces(source, partition.begin, partition.end):
                rows.append((partition.file_id, *row))
                if len(rows) == 64:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class FastaSource(DataSource):
    """Options: path (files or folders, several with a line end between), split_bytes. A file whose name ends in .gz is read by one task."""

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        paths = [p for p in self.options["path"].split("\n") if p]
        return _Reader(paths, to_arrow_schema(schema), int(self.options.get("split_bytes", SPLIT_BYTES)))


def fasta_chunks(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(chr, chunk, bases) of FASTA files, upper case: `chunk` bases in each row but a contig's last. Work and memory grow in proportion to
    the files' bytes, whether a contig is one line or many. Bases before the first header are left out; a contig without bases has no
    row, and one that several headers name has the bases of all of them, a row of each for each chunk."""
    spark.dataSource.register(FastaSource)
    read = spark.read.format("fasta_pieces").option("split_bytes", split_bytes).load(paths if isinstance(paths, str) else "\n".join(paths))
    placed = ordered.ranged(read.withColumnRenamed("name", "_name"), ["file_id"], ["at"])
    placed = ordered.running_sum(placed, ["file_id"], F.col("_name").isNotNull().cast("long"), "record")
    placed = ordered.filled(placed, ["file_id"], "_name", "chr").withColumn("n", F.length("bases").cast("long"))
    placed = ordered.running_sum(placed.where("record > 0"), ["file_id", "record"], F.col("n"), "end").where("n > 0")
    begin = F.col("end") - F.col("n")
    spread = placed.withColumn("begin", begin).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / chunk), F.floor((F.col("end") - 1) / chunk))))
    cut = F.expr(f"substring(bases, cast(greatest(chunk * {chunk} - begin, 0) as int) + 1, cast(least((chunk + 1) * {chunk}, end) - greatest(chunk * {chunk}, begin) as int))")
    parts = spread.groupBy("chr", "file_id", "record", "chunk").agg(F.array_sort(F.collect_list(F.struct("begin", cut.alias("bases")))).alias("parts"))
    return parts.select("chr", "chunk", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(chr, length, md5) of contigs in chunks: a contig's chunks pass through one digest in order, a batch in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, digest = None, 0, None
        row = lambda: pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["chr", "length", "md5"])
        for batch in batches:
            for chr, bases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or chr != name:
                    if digest is not None:
                        yield row()
                    name, n, digest = chr, 0, hashlib.md5(usedforsecurity=False)
                digest.update(bases.encode())
                n += len(bases)
        if digest is not None:
            yield row()

    dealt = chunks.repartition("chr").sortWithinPartitions("chr", "chunk")
    return dealt.select("chr", "bases").mapInArrow(run, "chr string, length long, md5 string")
