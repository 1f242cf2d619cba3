"""Token ids in files of length-delimited binary records, with an offset index beside each file for shuffled reads.

A record is its length (8 bytes), the masked CRC-32C of the length, the data and the masked CRC-32C of the data, all
little-endian: the framing that readers of this kind of file know. The data is a head and a document's ids. The index
is a fixed-width entry a record, so that record k of a file is found without reading those before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches, materialize, shared_path
from readloom.llm.packing import TEXT_BYTES, by_bytes, encoder, laid_out

# Fixed values of the framing: the reversed polynomial of CRC-32C, and what is added to a checksum when it is masked.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Data begins with: bytes of an id, 1 if the document has no id, two unused bytes, the number of ids, the document's id.
HEAD = struct.Struct("<BBxxIq")
#: Before and behind the data.
LENGTH, CHECK = struct.Struct("<QI"), struct.Struct("<I")
#: An index entry: the record's offset, the size of its data and its number of ids.
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("ids", "<u8")])
#: A new file is begun after so many bytes. Documents that are looked up, and bytes that are read, at a time.
FILE_BYTES, DOCS, READ_BYTES = 64 << 20, 256, 8 << 20
#: Bytes whose checksum is taken by position, before such pieces are combined.
PIECE = 64
#: Rows of equal documents are dealt to so many places of the order.
SALTS = 1 << 16


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (table & np.uint32(1)))
    return table


_BYTE = _byte_table()


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more zero byte."""
    return _BYTE[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _positions() -> list[np.ndarray]:
    """By position in a piece, the checksum of each byte value there with zeros behind it."""
    tables = [_BYTE]
    while len(tables) < PIECE:
        tables.append(_zero_byte(tables[-1]))
    return tables[::-1]


class _Shift:
    """Checksums after so many zero bytes: a linear map, as a table for each of a checksum's four bytes."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        a, b, c, d = self.tables
        low = np.uint32(255)
        return a[crc & low] ^ b[(crc >> np.uint32(8)) & low] ^ c[(crc >> np.uint32(16)) & low] ^ d[crc >> np.uint32(24)]

    def doubled(self) -> _Shift:
        return _Shift([self(t) for t in self.tables])


_POSITIONS = _positions()
#: By k, the shift over two to the power of k bytes.
_SHIFTS = [_Shift([_zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])]
while len(_SHIFTS) < 48:
    _SHIFTS.append(_SHIFTS[-1].doubled())


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of several byte strings, all at once: zeros in front change nothing, so each is cut from its end into pieces, whose
    checksums are combined in pairs."""
    sizes = np.array([len(x) for x in parts], np.int64)
    pieces = -(-sizes // PIECE)
    ends = np.cumsum(pieces) * PIECE
    data = np.zeros(int(pieces.sum()) * PIECE, np.uint8)
    for part, end in zip(parts, ends.tolist(), strict=True):
        data[end - len(part) : end] = np.frombuffer(part, np.uint8)
    columns = np.ascontiguousarray(data.reshape(-1, PIECE).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for table, column in zip(_POSITIONS, columns, strict=True):
        crc ^= table[column]
    level = PIECE.bit_length() - 1
    while pieces.size and pieces.max() > 1:
        halves = -(-pieces // 2)
        padded = np.zeros(2 * int(halves.sum()), np.uint32)
        at = np.arange(len(crc)) + np.repeat(np.cumsum(2 * halves - pieces), pieces)  # an odd count gets a zero in front
        padded[at] = crc
        crc, pieces, level = _SHIFTS[level](padded[::2]) ^ padded[1::2], halves, level + 1
    out = np.zeros(len(parts), np.uint32)
    out[pieces > 0] = crc
    start = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        start = np.where((sizes >> k) & 1, _SHIFTS[k](start), start)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(parts: list[bytes]) -> list[bytes]:
    """Records of several data strings."""
    heads = [len(x).to_bytes(8, "little") for x in parts]
    checks = zip(masked(crc32c(heads)).tolist(), masked(crc32c(parts)).tolist(), strict=True)
    return [b"".join((h, CHECK.pack(a), x, CHECK.pack(b))) for h, x, (a, b) in zip(heads, parts, checks, strict=True)]


def unframed(records: list[bytes]) -> list[bytes]:
    """Data of records; a length or checksum that is not right is an error."""
    heads, parts = [x[:8] for x in records], [x[LENGTH.size : -CHECK.size] for x in records]
    found = [(int.from_bytes(x[:8], "little"), *CHECK.unpack_from(x, 8), *CHECK.unpack_from(x, len(x) - CHECK.size)) for x in records]
    for (n, head, data), part, a, b in zip(found, parts, masked(crc32c(heads)).tolist(), masked(crc32c(parts)).tolist(), strict=True):
        if head != a or n != len(part) or data != b:
            raise ValueError("a record's length or checksum is wrong")
    return parts


def sequence(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(width, doc_id is None, len(ids), doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parse_sequence(data: bytes) -> tuple[int | None, np.ndarray]:
    width, missing, n, doc_id = HEAD.unpack_from(data)
    ids = np.frombuffer(data, f"<u{width}", offset=HEAD.size).astype(np.uint32)
    if len(ids) != n:
        raise ValueError("a sequence has not as many ids as it says")
    return None if missing else doc_id, ids


def index_of(entries: list[tuple[int, int, int]]) -> bytes:
    """The index of a file's records, with its masked checksum behind it."""
    data = np.array(entries, ENTRY).tobytes()
    return data + CHECK.pack(int(masked(crc32c([data]))[0]))


class RecordFile:
    """Records of an open file by number, in any order."""

    def __init__(self, file: BinaryIO, index: bytes):
        self.file, self.entries = file, np.frombuffer(index[: -CHECK.size], ENTRY)
        if CHECK.unpack(index[-CHECK.size :])[0] != int(masked(crc32c([index[: -CHECK.size]]))[0]):
            raise ValueError("the index has a wrong checksum")

    def __len__(self) -> int:
        return len(self.entries)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        return self.read(k, k + 1)[0]

    def read(self, first: int, end: int) -> list[tuple[int | None, np.ndarray]]:
        """Records from number `first` on, by one range read."""
        own = self.entries[first:end]
        starts, ends = own["offset"].tolist(), (own["offset"] + own["size"]).tolist()
        frame = LENGTH.size + CHECK.size
        self.file.seek(starts[0])
        data = self.file.read(ends[-1] + frame - starts[0])
        return [parse_sequence(x) for x in unframed([data[a - starts[0] : b + frame - starts[0]] for a, b in zip(starts, ends, strict=True)])]

    def all(self, limit: int = READ_BYTES) -> Iterator[list[tuple[int | None, np.ndarray]]]:
        """All records in order, about `limit` bytes at a time."""
        first = 0
        while first < len(self.entries):
            end = int(np.searchsorted(self.entries["offset"], self.entries["offset"][first] + np.uint64(limit)))
            yield self.read(first, max(end, first + 1))
            first = max(end, first + 1)


def write_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all documents, in ascending order of doc_id, to files below `folder`: (path, records, ids, start), where start is
    the number of ids in all files before.

    Documents are dealt to tasks by ranges of their id, so that a file follows another; texts cross one exchange and are
    encoded behind it. Names are new for each attempt of a task, and only what a successful attempt returns is listed.
    """
    path = public_tokenizers.path(tokenizer)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        shared = encoder(path)
        width = 2 if shared.small else 4
        todo = by_bytes(rows, 1, min(file_bytes, TEXT_BYTES))
        batch, number = next(todo, None), 0
        while batch is not None:
            name, offset, entries = f"{top}/{uuid.uuid4().hex}.records", 0, []
            first = [batch.column(k)[0].as_py() for k in (0, 2, 3)]
            with store.open_output_stream(name) as sink:
                while batch is not None and offset < file_bytes:
                    ids = shared.encode(batch.column(1))
                    parts = [sequence(d, x, width) for d, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
                    for record, part, x in zip(framed(parts), parts, ids, strict=True):
                        sink.write(record)
                        entries.append((offset, len(part), len(x)))
                        offset += len(record)
                    batch = next(todo, None)
            with store.open_output_stream(name + ".index") as sink:
                sink.write(index_of(entries))
            row = [*first, number, name, len(entries), sum(n for _, _, n in entries)]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int64(),) * 4 + (pa.string(),) + (pa.int64(),) * 2, strict=True)], ["doc_id", "tie", "salt", "number", "path", "records", "ids"])
            number += 1

    keys = ["doc_id", "tie", "salt"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialize(placed.mapInArrow(run, "doc_id long, tie long, salt long, number long, path string, records long, ids long"), "token-files")
    return laid_out(written, "ids", [*keys, "number"]).select("path", "records", "ids", F.col("begin").alias("start"))


def _open(store: fs.FileSystem, path: str) -> tuple[pa.NativeFile, RecordFile]:
    with store.open_input_file(path + ".index") as f:
        index = f.read()
    file = store.open_input_file(path)
    return file, RecordFile(file, index)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _rows(found: list[tuple[int | None, np.ndarray]], starts: list[int], with_ids: bool) -> pa.RecordBatch:
    columns = [[d for d, _ in found], starts, [len(x) for _, x in found], [zlib.crc32(x.astype("<u4").tobytes()) for _, x in found]]
    if with_ids:
        columns.append([x.astype(np.int32) for _, x in found])
    schema = SCHEMA if with_ids else SCHEMA.remove(4)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COLUMNS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_files(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """A row for each record of the files that write_files lists, read in order: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if asked for, ids. A wrong length or checksum is an error."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in rows:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, records = _open(store, path)
                with file:
                    for found in records.all():
                        n = np.array([len(x) for _, x in found], np.int64)
                        begins = start + np.cumsum(n) - n
                        yield _rows(found, begins.tolist(), with_ids)
                        start += int(n.sum())

    return files.select("path", "start").mapInArrow(run, _COLUMNS + (", ids array<int>" if with_ids else ""))


def read_shuffled(files: DataFrame, folder: str, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """The rows of read_files in an order that follows from `seed`: record numbers of all files are dealt to tasks and sorted by a hash,
    and each record is read by its index entry."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        opened: dict[str, tuple[pa.NativeFile, RecordFile, np.ndarray]] = {}
        for batch in batches(rows, DOCS):
            found, starts = [], []
            for path, start, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path not in opened:
                    if len(opened) == 64:  # indexes in memory; the oldest goes
                        opened.pop(next(iter(opened)))[0].close()
                    file, records = _open(store, path)
                    opened[path] = file, records, np.cumsum(records.entries["ids"]) - records.entries["ids"]
                _, records, before = opened[path]
                found.append(records[k])
                starts.append(start + int(before[k]))
            if found:
                yield _rows(found, starts, with_ids)

    each = files.where("records > 0").select("path", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("k"))
    place = F.xxhash64(F.lit(seed), "start", "k")
    dealt = each.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place", "path", "k")
    return dealt.select("path", "start", "k").mapInArrow(run, _COLUMNS + (", ids array<int>" if with_ids else ""))


def encode_documents(docs: DataFrame, folder: str | None = None, tokenizer: str = "word_bpe_49k.json", with_ids: bool = True) -> DataFrame:
    """Writes the ids of all documents to files (in the shared folder unless one is given) and reads them back: doc_id,
    start, n_tokens, ids_crc32 and, if asked for, ids.

    A document's ids are the tokenizer's and id 1 at the end; a null or empty text has only that. Documents are in ascending order of
    doc_id, a null doc_id first; rows of one doc_id follow a hash of their text, and equal rows are records of their own. A very long
    text is one record, encoded in the memory of a task. Other columns are left out; an empty table gives no rows.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    files = materialize(write_files(docs, folder, tokenizer), "token-index")
    return read_files(files.repartition(max(1, files.count())), folder, with_ids)
