"""WARC in ZIP packages: archives written by tasks, and a reader that finds stored members through the central
directory and reads single records by range."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches, hot_keys, materialize, shared_path

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 1000
#: A new archive is begun after so many bytes of records.
ARCHIVE_BYTES = 32 << 20
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    size: int
    packed: int
    header: int  # offset of the local header


class ZipReader:
    """Members of a ZIP file that only needs seek() and read(); ZIP64 is understood, nothing is extracted."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"ZIP file ends inside of {offset}+{n}")
        return data

    def _end(self) -> tuple[int, int]:
        """Offset and size of the central directory."""
        n = min(self.size, 22 + 0xFFFF)
        tail = self.at(self.size - n, n)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        size, offset = struct.unpack_from("<II", tail, end + 12)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            record = self.at(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            size, offset = struct.unpack_from("<QQ", record, 40)
        return offset, size

    def _directory(self) -> Iterator[Member]:
        offset, size = self._end()
        data, at = self.at(offset, size), 0
        while at < len(data):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
            while extra + 4 <= end:
                kind, length = struct.unpack_from("<HH", data, extra)
                if kind == 1:  # the 64-bit forms of just those fields that are all ones
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", data, extra + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra += 4 + length
            yield Member(name, method, full, packed, header)
            at = end + n_note

    def start(self, member: Member) -> int:
        """Offset of a stored member's bytes; its local header may have other extra fields than the directory."""
        if member.method:
            raise ValueError(f"{member.name} is compressed, not stored")
        head = self.at(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {member.name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        """Bytes of a stored member from `offset` on."""
        member = self.members[name]
        n = member.size - offset if n is None else n
        if offset + n > member.size:
            raise ValueError(f"{name} has {member.size} bytes")
        return self.at(self.start(member) + offset, n)


def _headers(fields: dict[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without its payload; the HTTP header keeps the payload's length in both."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    fields |= {"WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.fields["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.fields.get("warc-refers-to", ""))


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse_record(data: bytes) -> Record:
    """A record from its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in top.decode().split("\r\n")[1:])}
    return Record(fields, http, payload)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the page that holds an equal payload for a revisit, else null.
    The pages of one payload are counted by digest before pages meet them. Payloads that are too short to be revisits meet nothing, and
    pages of a payload that more than one page in a thousand has stay where they are."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    long = keyed.where(F.col("n") >= min_revisit)
    equal = (
        long.groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("pages"))
        .where("pages > 1")
        .select("digest", "holder")
    )
    other = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    hot = F.broadcast(hot_keys(long, "digest", pages.count()))
    often = long.join(hot, "digest", "left_semi").join(F.broadcast(equal.join(hot, "digest", "left_semi")), "digest", "left")
    rare = long.join(hot, "digest", "left_anti").join(equal, "digest", "left")
    short = keyed.where(F.col("n") < min_revisit).withColumn("holder", F.lit(None).cast(keyed.schema["page_id"].dataType))
    columns = ["page_id", "url", "html", other.alias("refers_to")]
    return often.select(columns).unionByName(rare.select(columns)).unionByName(short.select(columns))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of each task into ZIP archives below `folder`; returns (path, records) of those written.

    Names are new for each attempt of a task, and only what a successful attempt returns is listed, so an attempt
    that was lost or repeated leaves at most an unlisted file.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        todo = (row for batch in batches(rows, 100) for row in batch.to_pylist())
        row = next(todo, None)
        while row is not None:
            path = f"{top}/{uuid.uuid4().hex}.wacz"
            store.create_dir(top)
            with store.open_output_stream(path) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                index: list[tuple[str, str]] = []
                with package.open(MEMBER, "w", force_zip64=True) as member:
                    offset = 0
                    while row is not None and offset < archive_bytes:
                        data = (row["html"] or "").encode()
                        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                        record = packer.compress(warc_record(row["page_id"], row["url"], data, row["refers_to"])) + packer.flush()
                        member.write(record)
                        entry = {"url": row["url"], "offset": offset, "length": len(record), "filename": MEMBER}
                        index.append((str(row["page_id"]), json.dumps(entry)))
                        offset += len(record)
                        row = next(todo, None)
                package.writestr(INDEX, "".join(f"{k} {DATE} {v}\n" for k, v in sorted(index)))
            yield pa.record_batch({"path": [path], "records": pa.array([len(index)], pa.int64())})

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record that the archives' indexes list, read by range: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and payload (null for revisits)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in rows:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    package = ZipReader(file, file.size())
                    entries = [json.loads(x.split(" ", 2)[2]) for x in package.read(INDEX).decode().splitlines()]
                    entries.sort(key=lambda e: e["offset"])
                    for i in range(0, len(entries), 100):
                        found = [read_record(package, e) for e in entries[i : i + 100]]
                        yield pa.RecordBatch.from_pylist(found, SCHEMA)

    return archives.select("path").mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_record(package: ZipReader, entry: dict) -> dict:
    """The record of an index entry; a response whose payload does not have its digest is an error."""
    data = zlib.decompress(package.read(entry["filename"], entry["offset"], entry["length"]), 31)
    record = parse_record(data)
    digest = base64.b32decode(record.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = record.fields["warc-type"]
    if kind == "response" and hashlib.sha1(record.payload).hexdigest() != digest:
        raise ValueError(f"payload of {record.fields['warc-record-id']} does not have its digest")
    return {
        "page_id": record.page_id,
        "url": entry["url"],
        "payload_bytes": int(record.http["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": record.refers_to,
        "payload": record.payload if kind == "response" else None,
    }


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes `pages` into archives (in the shared folder unless one is given) and reads them back.

    Null html is an empty payload. Of equal payloads of at least MIN_REVISIT bytes the largest page_id is the response;
    rows that repeat that page_id are responses too, rows with a null page_id revisit it.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    archives = materialize(write_archives(plan_records(pages), folder), "archives")
    n = archives.count()
    return read_archives(archives.repartition(max(1, n)), folder)
