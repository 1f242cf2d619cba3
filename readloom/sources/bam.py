"""BAM as a data source of Spark: `spark.read.format("bam").load(path)`, after register().

A file is dealt to tasks by ranges of its bytes. A task finds the first compressed block and the first record in its range,
and ends where the next range begins; both ends are found by the same rule, and a task that does not meet its end exactly is an
error. With an index (see index_bam), filters on contig and position choose the ranges that are read at all.
"""

from __future__ import annotations

import bisect
import gzip
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from readloom.operators.ranges import MAX_POS, Range, in_range
from readloom.schema import READS
from readloom.sources.records import BASES, BINS, FIXED, NUMBERS, OPS, Records  # noqa: F401

# A compressed block begins so, and has its size in the extra field of this name.
BLOCK_MAGIC, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC"
#: Bits of the width of the linear index's windows.
WINDOW_BITS = 14
#: Records, and bytes of them, in a batch at most; a record may be longer.
ROWS_PER_BATCH, BATCH_BYTES = 4096, 4 << 20
#: Bytes of a file in a range, and those read at a time; records in a row that tell a record's start.
SPLIT_BYTES, READ_BYTES, CHAIN = 32 << 20, 1 << 20, 8
_SIZE = struct.Struct("<i")
PLACES = "file_id int, chr string, begin long, end_excl long, v_begin long, v_end long"


def read_dictionary(f: BinaryIO) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the contigs."""
    if f.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, contigs


def block_size(head: bytes) -> int | None:
    """Size of the compressed block that begins so; None if none does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == BLOCK_FIELD and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class Blocks:
    """Compressed blocks of an open file; counts the bytes it reads."""

    def __init__(self, file: pa.NativeFile, size: int | None = None):
        self.file, self.size = file, file.size() if size is None else size
        self.at, self.held, self.bytes_read = 0, b"", 0

    def bytes(self, offset: int, n: int, ahead: int) -> bytes:
        """Up to n bytes from an offset on; reads `ahead` bytes where it has to read."""
        if not (self.at <= offset and min(offset + n, self.size) <= self.at + len(self.held)):
            self.file.seek(offset)
            self.at, self.held = offset, self.file.read(min(max(n, ahead), max(0, self.size - offset)))
            self.bytes_read += len(self.held)
        return self.held[offset - self.at : offset - self.at + n]

    def block(self, offset: int, ahead: int = 1 << 16) -> tuple[bytes, int] | None:
        """Content of the block that begins at an offset, and the next one's offset; None at the file's end or where no block begins."""
        n = block_size(self.bytes(offset, 512, ahead))
        if n is None:
            return None
        data = self.bytes(offset, n, ahead)
        try:
            content = zlib.decompress(data, 31)
        except zlib.error:
            return None
        return content, offset + n

    def next_block(self, offset: int) -> int:
        """Offset of the first block that begins at `offset` or later; the file's size if none does. A place that looks like a block is one if
        its content has its checksum and another block or the file's end follows."""
        while offset < self.size:
            data = self.bytes(offset, 1 << 16, 1 << 17)
            k = data.find(BLOCK_MAGIC)
            while k >= 0:
                found = self.block(offset + k)
                if found and (found[1] == self.size or block_size(self.bytes(found[1], 512, 1 << 16))):
                    return offset + k
                k = data.find(BLOCK_MAGIC, k + 1)
            offset += max(1, len(data) - 3)
        return self.size


class Content:
    """The decompressed bytes of blocks from an offset on, with the file place of each: place = block offset << 16 | offset in it."""

    def __init__(self, blocks: Blocks, offset: int, ahead: int = READ_BYTES):
        self.blocks, self.next, self.ahead = blocks, offset, ahead
        self.data, self.base, self.starts, self.offsets = bytearray(), 0, [], []  # base: bytes dropped in front

    def more(self) -> bool:
        """Adds a block; False at the end of the file."""
        if self.next >= self.blocks.size:
            return False
        found = self.blocks.block(self.next, min(self.ahead, 1 << 26))
        if found is None:
            raise ValueError(f"no compressed block at {self.next}")
        self.starts.append(self.base + len(self.data))
        self.offsets.append(self.next)
        self.data += found[0]
        self.next = found[1]
        return True

    def has(self, at: int, n: int) -> bool:
        while self.base + len(self.data) < at + n:
            if not self.more():
                return False
        return True

    def place(self, at: np.ndarray) -> np.ndarray:
        """File places of places in the content; that of a block's end is the next block's start."""
        starts, offsets = np.array([*self.starts, self.base + len(self.data)]), np.array([*self.offsets, self.next])
        k = np.searchsorted(starts, at, "right") - 1
        return (offsets[k].astype(np.int64) << 16) | (at - starts[k])

    def drop(self, at: int) -> None:
        """Forgets what is before `at`, whole blocks only."""
        k = int(np.searchsorted(np.array(self.starts), at, "right")) - 1
        if k > 0:
            del self.data[: self.starts[k] - self.base]
            self.base = self.starts[k]
            del self.starts[:k], self.offsets[:k]


def _plausible(data: np.ndarray, n_refs: int) -> np.ndarray:
    """Places where the fixed part of a record can begin."""
    n = len(data) - FIXED.itemsize
    if n <= 0:
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    at = lambda name: np.ndarray((n,), FIXED.fields[name][0], raw, FIXED.fields[name][1], (1,))
    size, n_name, n_ops, n_seq = (at(k).astype(np.int64) for k in ("size", "n_name", "n_ops", "n_seq"))
    ok = (n_name > 0) & (n_seq >= 0) & (32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq <= size)
    for k in ("ref", "mate_ref"):
        ok &= (at(k) >= -1) & (at(k) < n_refs)
    for k in ("pos", "mate_pos"):
        ok &= at(k) >= -1
    found = np.flatnonzero(ok)
    end = found + FIXED.itemsize + n_name[found] - 1
    inside = end < len(data)
    return found[~inside | (data[np.minimum(end, len(data) - 1)] == 0)]


def _chain(data: np.ndarray, at: int, n_refs: int, whole: bool) -> tuple[bool | None, list[int]]:
    """A record begins at a place, since CHAIN records follow one another from there, or as many as there are to the file's end; None if
    more data must tell. And where the records begin that follow, as far as there is data. `whole`: nothing follows the data."""
    trail = []
    for _ in range(CHAIN):
        if at == len(data) and whole:
            return True, trail
        if at + FIXED.itemsize + 256 > len(data) and not whole:
            return None, trail
        if 0 not in _plausible(data[at : at + FIXED.itemsize + 256], n_refs):
            return False, trail
        at += 4 + int.from_bytes(data[at : at + 4].tobytes(), "little", signed=True)
        if at > len(data):
            return (False if whole else None), trail
        trail.append(at)
    return True, trail


def first_record(blocks: Blocks, offset: int, n_refs: int) -> int:
    """Place of the first record in the blocks that begin at `offset` or later; the file's end if there is none. A place that more data must
    tell of gives way to a later one that is told, unless that follows from it: what looks like a very long record mostly is none, and
    no file is read to its end for it."""
    content, done, wanted = Content(blocks, blocks.next_block(offset), 1 << 16), 0, 0
    while content.more():
        while len(content.data) < wanted and content.more():
            pass
        wanted = 2 * len(content.data)
        data, whole = np.frombuffer(bytes(content.data), np.uint8), content.next >= blocks.size
        open_places: list[tuple[int, list[int]]] = []
        for c in _candidates(data, done, n_refs):
            found, trail = _chain(data, c, n_refs, whole)
            if found:
                first = next((p for p, then in open_places if c in then), c)
                return int(content.place(np.array([first]))[0])
            if found is None:
                open_places.append((c, trail))
        done = open_places[0][0] if open_places else max(done, len(data) - FIXED.itemsize)
    return blocks.size << 16


def _candidates(data: np.ndarray, at: int, n_refs: int, width: int = 1 << 10) -> Iterator[int]:
    """The plausible places from one on, looked for a window at a time: the first record is mostly near."""
    last = len(data) - FIXED.itemsize
    for low in range(at, last, width):
        found = low + _plausible(data[low : low + width + FIXED.itemsize + 256], n_refs)
        yield from found[found < low + width].tolist()


def located_records(blocks: Blocks, begin: int, end: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Content, record starts in it and their file places (one more: the end), for the records from place `begin` up to place `end`, in batches."""
    content = Content(blocks, begin >> 16, min(READ_BYTES, max(1 << 16, (end >> 16) - (begin >> 16) + (1 << 16))))
    at, last = begin & 0xFFFF, False
    while not last:
        starts = []
        content.has(at, 0)
        while len(starts) < ROWS_PER_BATCH and (not starts or at - starts[0] < BATCH_BYTES):
            at = _whole_records(content, at, _held_before(content, end), starts)
            # places are checked where the held blocks or the range end
            if not content.has(at, 4):
                if content.has(at, 1):
                    raise ValueError("the file ends inside of a record")
                last = True
                break
            if content.offsets[-1] >= end >> 16 and int(content.place(np.array([at]))[0]) >= end:
                last = True
                break
            starts.append(at)
            n = int.from_bytes(content.data[at - content.base : at - content.base + 4], "little", signed=True)
            if n < 32 or not content.has(at, 4 + n):
                raise ValueError("the file ends inside of a record" if n >= 32 else "a record has no length; this range did not begin at a record")
            at += 4 + n
        content.has(at, 4)  # empty blocks before the next record are passed
        places = content.place(np.array([*starts, at]))
        if last and end < blocks.size << 16 and int(places[-1]) != end:
            raise ValueError(f"records do not meet at {end >> 16}; read this file with the option split=false")
        if starts:
            yield bytes(content.data), np.array(starts) - content.base, places
        content.drop(at)


def _held_before(content: Content, end: int) -> int:
    """Where, in the held content, what lies before a place of the file ends."""
    k = bisect.bisect_left(content.offsets, end >> 16)
    if k == len(content.offsets):
        return content.base + len(content.data)
    return content.starts[k] + ((end & 0xFFFF) if content.offsets[k] == end >> 16 else 0)


def _whole_records(content: Content, at: int, before: int, starts: list[int]) -> int:
    """Adds to `starts` the records that begin before a place and are held whole, as many as a batch may have; the place behind them."""
    data, base, filled = content.data, content.base, content.base + len(content.data)
    stop = min(before, filled - 3, (starts[0] if starts else at) + BATCH_BYTES)
    room = ROWS_PER_BATCH - len(starts)
    while at < stop and room > 0:
        n = _SIZE.unpack_from(data, at - base)[0]
        if n < 32 or at + 4 + n > filled:
            break
        starts.append(at)
        at, room = at + 4 + n, room - 1
    return at


def _gzip_records(f: BinaryIO) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The same for a stream that is not made of blocks; a record's place is its offset in the content."""
    base, held, done = 0, b"", False
    while not done:
        data = f.read(READ_BYTES)
        done, held = not data, held + data
        starts, at = [], 0
        while at + 4 <= len(held):
            n = int.from_bytes(held[at : at + 4], "little", signed=True)
            if at + 4 + n > len(held):
                break
            starts.append(at)
            at += 4 + n
        if starts:
            yield held, np.array(starts), base + np.array([*starts, at])
        base, held = base + at, held[at:]
    if held:
        raise ValueError("the file ends inside of a record")


def decode(data: bytes, starts: np.ndarray, places: np.ndarray, contigs: list[str], file_id: int, schema: pa.Schema) -> pa.RecordBatch:
    """Records as reads, by column; only columns of `schema` are made."""
    records = Records(data, starts)
    fixed, names = records.fixed, pa.array([*contigs, "*", "="])
    refs, mates = fixed["ref"], fixed["mate_ref"]
    name = lambda of: names.take(pa.array(np.where(of < 0, len(contigs), of)))
    columns = {
        "file_id": lambda: np.full(len(starts), file_id, np.int32),
        "row_id": lambda: places[:-1],
        "flag": lambda: fixed["flag"].astype(np.int32),
        "chr": lambda: name(refs),
        "pos": lambda: fixed["pos"].astype(np.int64) + 1,
        "mapq": lambda: fixed["mapq"].astype(np.int32),
        "pchr": lambda: name(np.where((mates == refs) & (refs >= 0), len(contigs) + 1, mates)),
        "ploc": lambda: fixed["mate_pos"].astype(np.int64) + 1,
        "tlen": lambda: fixed["tlen"],
        "rname": records.rname,
        "cigar": records.cigar,
        "seq": records.seq,
        "qual": records.qual,
    }
    made = [records.tags(f.type) if f.name == "tags" else _as_type(columns[f.name](), f.type) for f in schema]
    return pa.record_batch(made, schema=schema)


def _as_type(column: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    return column.cast(kind) if isinstance(column, pa.Array) else pa.array(column, kind)


def places_of(data: bytes, starts: np.ndarray, places: np.ndarray, contigs: list[str], file_id: int, schema: pa.Schema) -> pa.RecordBatch:
    """(file_id, chr, begin, end_excl, v_begin, v_end): where records lie on contigs and in the file."""
    records = Records(data, starts)
    begin, refs = records.fixed["pos"].astype(np.int64), records.fixed["ref"]
    chr_ = pa.array([*contigs, "*"]).take(pa.array(np.where(refs < 0, len(contigs), refs)))
    columns = [np.full(len(starts), file_id, np.int32), chr_, begin, begin + np.maximum(records.spans(), 1), places[:-1], places[1:]]
    return pa.record_batch([_as_type(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass
class _Part(InputPartition):
    """A range of a file: bytes whose records are to be found, or places that an index gives."""

    file_id: int
    path: str
    begin: int
    end: int
    placed: bool = False


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> BinaryIO:
    store, at = _located(path)
    return gzip.open(store.open_input_file(at))


def is_blocked(path: str) -> bool:
    store, at = _located(path)
    with store.open_input_file(at) as f:
        return block_size(f.read(512)) is not None


def index_path(path: str) -> str:
    return path + ".places"


def bins_of(begin: int, end: int) -> list[tuple[int, int]]:
    """First and last number, by level, of the bins that meet positions begin to end (from 0, end not included)."""
    return [(first + (begin >> bits), first + (max(begin, end - 1) >> bits)) for first, bits in BINS]


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema, split_bytes: int, split: bool, places: bool, contig: str | None):
        self.paths, self.schema, self.split_bytes, self.split, self.places = paths, schema, split_bytes, split, places
        self.contigs, self.low, self.high = {contig} if contig is not None else None, 1, MAX_POS

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Contigs and positions narrow what is read; all filters are still evaluated, since blocks hold other records too."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("chr",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.contigs = values if self.contigs is None else self.contigs & values
            elif name == ("pos",) and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif name == ("pos",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("pos",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[_Part]:
        out = []
        for i, path in enumerate(self.paths):
            store, at = _located(path)
            if not is_blocked(path) or not self.split:
                out.append(_Part(i, path, 0, -1))
                continue
            spans = self._spans(path) if self.contigs is not None and not self.places else None
            if spans is not None:
                out += [_Part(i, path, a, b, True) for a, b in spans]
            else:
                size = store.get_file_info(at).size
                out += [_Part(i, path, a, min(a + self.split_bytes, size)) for a in range(0, max(size, 1), self.split_bytes)]
        return out or [_Part(0, self.paths[0], 0, 0, True)]

    def _spans(self, path: str) -> list[tuple[int, int]] | None:
        """Ranges of places that can hold the filters' reads, by the file's index: those of the bins that the positions meet, from the first
        read on that reaches the first window. None without an index."""
        store, at = _located(index_path(path))
        if store.get_file_info(f"{at}/chunks/_SUCCESS").type == fs.FileType.NotFound or store.get_file_info(f"{at}/windows/_SUCCESS").type == fs.FileType.NotFound:
            return None
        begin, end = max(0, self.low - 1), max(self.low, self.high)
        chosen = ds.field("chr").isin([c for c in self.contigs if c is not None])
        in_bins = None
        for first, last in bins_of(begin, end):
            level = (ds.field("bin") >= first) & (ds.field("bin") <= last)
            in_bins = level if in_bins is None else in_bins | level
        chunks = ds.dataset(f"{at}/chunks", filesystem=store, format="parquet").to_table(filter=chosen & in_bins).to_pylist()
        windows = ds.dataset(f"{at}/windows", filesystem=store, format="parquet").to_table(filter=chosen & (ds.field("window") >= begin >> WINDOW_BITS))
        least: dict[str, int] = {}
        for r in windows.group_by("chr").aggregate([("v_first", "min")]).to_pylist():
            least[r["chr"]] = r["v_first_min"]
        spans = sorted((max(r["v_begin"], least[r["chr"]]), r["v_end"]) for r in chunks if r["chr"] in least and r["v_end"] > least[r["chr"]])
        out: list[tuple[int, int]] = []
        for a, b in spans:  # overlapping ones are joined, and near ones up to a split's bytes
            if out and (a < out[-1][1] or (a >> 16) - (out[-1][1] >> 16) <= 1 << 16 and (b >> 16) - (out[-1][0] >> 16) <= self.split_bytes):
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, at = _located(partition.path)
        if partition.begin == partition.end:
            return
        with _open(partition.path) as f:
            contigs = [name for name, _ in read_dictionary(f)[1]]
            head = f.tell()
            made = places_of if self.places else decode
            if partition.end < 0:
                for found in _gzip_records(f):
                    yield made(*found, contigs, partition.file_id, self.schema)
                return
        with store.open_input_file(at) as file:
            blocks = Blocks(file)
            begin, end = partition.begin, partition.end
            if not partition.placed:
                begin = _after_header(blocks, head) if not begin else first_record(blocks, begin, len(contigs))
                end = first_record(blocks, end, len(contigs)) if end < blocks.size else blocks.size << 16
            if begin < end:
                for found in located_records(blocks, begin, end):
                    yield made(*found, contigs, partition.file_id, self.schema)


def _after_header(blocks: Blocks, head: int) -> int:
    """Place of the first record, behind `head` bytes of content."""
    content = Content(blocks, 0, 1 << 16)
    content.has(0, head)
    return int(content.place(np.array([head]))[0])


class BamSource(DataSource):
    """Options: path (several with `;` between), split_bytes, split=false for one task a file, places=true for the places of records instead of
    reads, contig to choose one as a filter does."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _places(self) -> bool:
        return self.options.get("places", "false").lower() == "true"

    def schema(self) -> str:
        return PLACES if self._places() else READS

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        paths = [p for p in self.options["path"].split(";") if p]
        split = self.options.get("split", "true").lower() != "false"
        return _Reader(paths, to_arrow_schema(schema), int(self.options.get("split_bytes", SPLIT_BYTES)), split, self._places(), self.options.get("contig"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_bam(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of BAM files, in schema READS; row_id is a record's place in its file and follows its order. Files of compressed blocks are read
    by ranges of so many bytes, others by one task each. Filters on chr and pos read only some ranges of files that have an index."""
    register(spark)
    return spark.read.format("bam").option("split_bytes", split_bytes).load(paths if isinstance(paths, str) else ";".join(paths))


def bin_of(begin: Column, end: Column) -> Column:
    """The smallest bin that holds positions begin to end (from 0, end not included)."""
    out = F.lit(0).cast("long")
    for first, bits in BINS[1:]:
        out = F.when(F.shiftright(begin, bits) == F.shiftright(end - 1, bits), first + F.shiftright(begin, bits)).otherwise(out)
    return out


def index_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Writes a file's index beside it, as Parquet: the places of each bin's records (chr, bin, v_begin, v_end), a row for each run of blocks,
    and the first place of a record that reaches each window of positions (chr, window, v_first). Records of one block and bin are one row before
    anything is shuffled by bin."""
    register(spark)
    places = spark.read.format("bam").option("split_bytes", split_bytes).option("places", "true").load(path).where("chr <> '*'")
    block = F.shiftright("v_begin", 16)
    held = places.groupBy("chr", bin_of(F.col("begin"), F.col("end_excl")).alias("bin"), block.alias("block")).agg(F.min("v_begin").alias("v_begin"), F.max("v_end").alias("v_end"))
    w = Window.partitionBy("chr", "bin").orderBy("v_begin")
    new = F.coalesce(F.shiftright("v_begin", 16) > F.shiftright(F.lag("v_end").over(w), 16), F.lit(True)).cast("int")
    runs = held.withColumn("run", new).withColumn("run", F.sum("run").over(w)).groupBy("chr", "bin", "run").agg(F.min("v_begin").alias("v_begin"), F.max("v_end").alias("v_end"))
    runs.drop("run").repartitionByRange("chr", "bin").sortWithinPartitions("chr", "bin").write.mode("overwrite").parquet(index_path(path) + "/chunks")
    spread = F.explode(F.sequence(F.shiftright("begin", WINDOW_BITS), F.shiftright(F.col("end_excl") - 1, WINDOW_BITS)))
    windows = places.select("chr", "v_begin", spread.alias("window")).groupBy("chr", "window").agg(F.min("v_begin").alias("v_first"))
    windows.repartitionByRange("chr", "window").sortWithinPartitions("chr", "window").write.mode("overwrite").parquet(index_path(path) + "/windows")


def read_bam_range(spark: SparkSession, path: str, r: Range, overlap: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of a range of one file, with ref_span and end_excl; with an index, from the blocks that can hold them."""
    from readloom.operators.pileup import with_spans

    reads = read_bam(spark, path, split_bytes).where((F.col("chr") == r.chr) & (F.col("pos") <= r.end))
    if not overlap:
        reads = reads.where(F.col("pos") >= r.start)
    return with_spans(reads).where(in_range(r, overlap)).drop("ops")


def read_bam_header(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Header lines in schema HEADERS, and (file_id, chr_no, chr, length) of the contig dictionaries."""
    from readloom.functions.fields import header_attributes

    lines, contigs = [], []
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        with _open(path) as f:
            text, found = read_dictionary(f)
        lines += [(i, n, x) for n, x in enumerate(text.splitlines()) if x.startswith("@")]
        contigs += [(i, n, name, length) for n, (name, length) in enumerate(found)]
    raw = spark.createDataFrame(lines, "file_id int, line_no long, raw string")
    parsed = header_attributes(F.col("raw"))
    header = raw.select("file_id", "line_no", parsed["record_type"].alias("record_type"), parsed["attrs"].alias("attrs"), "raw")
    return header, spark.createDataFrame(contigs, "file_id int, chr_no int, chr string, length long")
