"""Sinks with a commit: files of alignment text and BAM, header first, that appear when all tasks have written and not before.

A task writes its rows to files of new names in a hidden folder and tells their names; what the driver is told is moved to its
place, the rest goes with the hidden folder. An attempt that fails or is repeated leaves nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from readloom.schema import LINE
from readloom.sources.records import encode_reads

#: Bytes of content in a compressed block of BAM, and those that are copied at a time where parts become a file.
BLOCK_BYTES, COPY_BYTES = 0xFF00, 8 << 20
# Fixed value of the format: the empty block at a file's end.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HIDDEN = "_writing"

def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- records of BAM


def compressed_block(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def dictionary(header: str) -> tuple[bytes, dict[str, int]]:
    """The head of a BAM file, and contigs by number, of header text with @SQ lines."""
    fields = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) for line in header.splitlines() if line.startswith("@SQ\t")]
    text = header.encode()
    out = [b"BAM\x01", struct.pack("<i", len(text)), text, struct.pack("<i", len(fields))]
    for f in fields:
        name = f["SN"].encode() + b"\0"
        out.append(struct.pack("<i", len(name)) + name + struct.pack("<i", int(f.get("LN", 0))))
    return b"".join(out), {f["SN"]: i for i, f in enumerate(fields)}


class _Text:
    """Lines; `head` and `tail` are what stands before and behind those of all parts of a file."""

    def __init__(self, sink: pa.NativeFile, header: str):
        self.sink, self.header = sink, header

    def head(self) -> None:
        self.sink.write(self.header.encode())

    def add(self, rows: pa.RecordBatch) -> None:
        self.sink.write("".join(f"{v}\n" for v in rows.column("value").to_pylist()).encode())

    def end(self) -> None:
        pass

    tail = end


class _Bam:
    """Compressed blocks of records; those of the header and the empty one at the end are `head` and `tail`."""

    def __init__(self, sink: pa.NativeFile, header: str):
        self.sink, self.held = sink, b""
        self.top, self.number = dictionary(header)

    def _flush(self, least: int = BLOCK_BYTES) -> None:
        at = 0
        while len(self.held) - at >= least:
            self.sink.write(compressed_block(self.held[at : at + BLOCK_BYTES]))
            at += BLOCK_BYTES
        self.held = self.held[at:]

    def head(self) -> None:
        self.held = self.top
        self._flush(1)  # records begin with a block of their own

    def add(self, rows: pa.RecordBatch) -> None:
        self.held += encode_reads(rows, self.number)
        self._flush()

    def end(self) -> None:
        self._flush(1)

    def tail(self) -> None:
        self.sink.write(END_BLOCK)


@dataclass
class _Wrote(WriterCommitMessage):
    """Files of a task: (file_id, number of its first row, hidden path)."""

    files: list[tuple[int, int, str]]


class _Writer(DataSourceArrowWriter):
    """Takes rows (file_id, place, ...) of which a task has those of one file together and in order."""

    def __init__(self, kind: str, options: dict[str, str], overwrite: bool):
        self.kind, self.overwrite, self.run = kind, overwrite, uuid.uuid4().hex
        self.headers, self.names = json.loads(options.get("headers", "{}")), json.loads(options.get("names", "{}"))
        self.single, self.path = options.get("single", "false").lower() == "true", options["path"].rstrip("/")

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        store, top = _located(self.path)
        return store, top, f"{top}/{HIDDEN}-{self.run}"

    def _body(self, sink: pa.NativeFile, file_id: int | None) -> _Text | _Bam:
        return (_Bam if self.kind == "bam" else _Text)(sink, self.headers.get(str(file_id), ""))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        """A file for each stretch of rows of one file. With `single` it is a part of that file, else one by itself: of BAM it has head and tail, and
        lines have a header of their own."""
        store, _, hidden = self._store()
        store.create_dir(hidden)
        out: list[tuple[int, int, str]] = []
        alone, body = self.kind == "bam" and not self.single, None

        def close() -> None:
            if body:
                body.end()
                if alone:
                    body.tail()
                body.sink.close()

        try:
            for batch in iterator:
                ids, at = batch.column("file_id").to_pylist(), 0
                while at < len(ids):
                    n = len(ids) - at if ids[at] == ids[-1] else next(k for k in range(at, len(ids)) if ids[k] != ids[at]) - at
                    if body is None or out[-1][0] != ids[at]:
                        close()
                        out.append((ids[at], batch.column("place")[at].as_py(), f"{hidden}/{uuid.uuid4().hex}"))
                        body = self._body(store.open_output_stream(out[-1][2]), ids[at])
                        if alone:
                            body.head()
                    body.add(batch.slice(at, n))
                    at += n
            close()
        finally:
            if body:
                body.sink.close()
        return _Wrote(out)

    def _joined(self, store: fs.FileSystem, hidden: str, file_id: str, parts: list[str]) -> str:
        """The parts of a file laid end to end, between its head and its tail; each goes when it is copied."""
        name = f"{hidden}/{uuid.uuid4().hex}"
        with store.open_output_stream(name) as sink:
            body = self._body(sink, file_id)
            body.head()
            for part in parts:
                with store.open_input_stream(part) as source:
                    while data := source.read(COPY_BYTES):
                        sink.write(data)
                store.delete_file(part)
            body.tail()
        return name

    def commit(self, messages: list[_Wrote | None]) -> None:
        """Moves what the tasks told to `<name>` with single, else to `<name>/part-<n>` in the order of the rows, the header's lines first."""
        store, top, hidden = self._store()
        store.create_dir(hidden)
        parts: dict[str, list[tuple[int, str]]] = {}
        for m in messages:
            for file_id, first, name in m.files if m else ():
                parts.setdefault(str(file_id), []).append((first, name))
        for file_id, text in self.headers.items():
            if self.kind == "sam" and not self.single:
                name = f"{hidden}/{uuid.uuid4().hex}"
                with store.open_output_stream(name) as sink:
                    sink.write(text.encode())
                parts.setdefault(file_id, []).append((-1, name))
            elif file_id not in parts:  # a file without rows
                parts[file_id] = [] if self.single else [(0, self._joined(store, hidden, file_id, []))]
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(top)):
                if info.base_name != f"{HIDDEN}-{self.run}":
                    (store.delete_file if info.is_file else store.delete_dir)(info.path)
        for file_id, found in parts.items():
            to = f"{top}/{self.names.get(file_id, f'{file_id}.{self.kind}')}"
            if store.get_file_info(to).type != fs.FileType.NotFound:
                raise FileExistsError(to)
            if not self.single:
                store.create_dir(to)
            else:
                found = [(0, self._joined(store, hidden, file_id, [name for _, name in sorted(found)]))]
            for i, (_, name) in enumerate(sorted(found)):
                store.move(name, to if self.single else f"{to}/part-{i:05d}.{self.kind}")
        self.abort(messages)

    def abort(self, messages: list[_Wrote | None]) -> None:
        store, _, hidden = self._store()
        with suppress(FileNotFoundError):
            store.delete_dir(hidden)


class SamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer("sam", self.options, overwrite)


class BamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer("bam", self.options, overwrite)


def headers_of(header: DataFrame) -> dict[str, str]:
    """Header text by file; headers are small."""
    lines: dict[str, list] = {}
    for r in header.select("file_id", "line_no", "raw").collect():
        lines.setdefault(str(r["file_id"]), []).append((r["line_no"], r["raw"]))
    return {k: "".join(f"{raw}\n" for _, raw in sorted(v)) for k, v in lines.items()}


def write_files(reads: DataFrame, path: str, header: DataFrame | None = None, kind: str = "sam", names: dict[int, str] | None = None, order: list[str] | None = None, single: bool = False, overwrite: bool = False) -> None:
    """Writes reads (schema READS) as the files they came from, by file_id, each in `order` (row_id unless given) behind its header.

    A file's rows are dealt to tasks by ranges of the order; the parts of a file that is dealt to several are in a folder of its
    name, and laid end to end they are its text (parts of BAM are files of their own, each with the header). With
    `single`, the commit lays them end to end, so a file is one file; the driver copies its bytes, a few at a time. `names` gives names by file_id."""
    from readloom.sources.text import sam_line

    spark: SparkSession = reads.sparkSession
    spark.dataSource.register(SamSink)
    spark.dataSource.register(BamSink)
    keys = ["file_id", *(order or ["row_id"])]
    placed = reads.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    body = [sam_line().alias("value")] if kind == "sam" else [*LINE, "tags"]
    options = {"headers": json.dumps(headers_of(header) if header is not None else {}), "names": json.dumps({str(k): v for k, v in (names or {}).items()}), "single": str(single)}
    writer = placed.select("file_id", "place", *body).write.format(f"{kind}_files").options(**options)
    writer.mode("overwrite" if overwrite else "append").save(path)
