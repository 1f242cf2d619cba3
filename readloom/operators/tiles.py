"""Counts of bases by tiles of positions: a dense array for each contig and stretch of CHUNK positions, which tasks fill with their
reads and which are then added up, so that a tile crosses the exchange once a task and not once a base."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.pileup import CHUNK

#: Lanes of a position, and operations that give it a base.
LANES, DELETED, ALIGNED = ".ACGTN", "D", "M=X"
#: Tiles that a task keeps before it sends them, and bases that it places at a time.
MOST_TILES, MOST_BASES = 256, 1 << 19
#: Counters that may be laid out for each base that is counted in them.
DENSE = 4
SCHEMA = "chr string, chunk long, counts binary"
_LANE = np.full(256, LANES.index("N"), np.uint8)
for _i, _c in enumerate(LANES):
    _LANE[[ord(_c), ord(_c.lower())]] = _i
_CIGAR = re.compile(r"(\d*)([MIDNSHP=X])")


def pack(counts: np.ndarray) -> bytes:
    """Counts of a tile, compressed: equal bytes of all counts together, since most are zero."""
    raw = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Counts by position of the tile and lane."""
    size = chunk * len(LANES)
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, size * 8, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64).reshape(chunk, -1)


def _steps(cigar: str | None) -> list[tuple[int, int, int, bool]]:
    """(reference offset, read offset, length, deleted) of the operations that cover positions."""
    out, ref, read = [], 0, 0
    for n, op in _CIGAR.findall(cigar or ""):
        n = int(n or 0)
        if n and op in ALIGNED + DELETED:
            out.append((ref, read, n, op == DELETED))
        ref += n if op in "M=XDN" else 0
        read += n if op in "M=XIS" else 0
    return out


def placed_bases(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, reads: list[tuple[int, int, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, position from 0, lane) of all bases: `reads` are (number, first position, cigar), whose bases are data[starts:ends]."""
    known: dict[str | None, list] = {}
    rows, refs, froms, sizes, gone = [], [], [], [], []
    for number, pos, cigar in reads:
        if cigar not in known:
            known[cigar] = _steps(cigar)
        for ref, read, n, deleted in known[cigar]:
            n = n if deleted else min(n, int(ends[number] - starts[number]) - read)  # bases that a read lacks cover nothing
            if n > 0:
                rows.append(number)
                refs.append(pos - 1 + ref)
                froms.append(int(starts[number]) + read)
                sizes.append(n)
                gone.append(deleted)
    n = np.array(sizes, np.int64)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    lane = np.zeros(len(within), np.uint8)
    real = np.repeat(~np.array(gone, bool), n)
    lane[real] = _LANE[data[(np.repeat(np.array(froms, np.int64), n) + within)[real]]]
    return np.repeat(np.array(rows, np.int64), n), np.repeat(np.array(refs, np.int64), n) + within, lane


def partial_counts(reads: DataFrame, chunk: int = CHUNK, carry: str | None = None) -> DataFrame:
    """(chr, chunk, counts): what each task counts; see tile_counts. With `carry`, also carried, a whole number that all reads of a contig
    have in that column."""
    width = len(LANES)
    names = ["chr", "chunk", "counts", *(["carried"] if carry else [])]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[str, int], np.ndarray] = {}
        carried: dict[str, int | None] = {}

        def sent() -> pa.RecordBatch:
            keys = list(tiles)
            packed = [pack(tiles[k]) for k in keys]
            tiles.clear()
            columns = [pa.array([c for c, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()), pa.array(packed, pa.binary())]
            return pa.record_batch([*columns, pa.array([carried.get(c) for c, _ in keys], pa.int64())][: 4 if carry else 3], names)

        for batch in batches:
            seq = batch.column(3).cast(pa.binary()).cast(pa.large_binary())
            bounds = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)
            sizes = bounds[1:] - bounds[:-1]
            contigs, where = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            if carry:
                carried |= dict(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
            each = list(zip(range(len(seq)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            group = np.cumsum(sizes) // MOST_BASES
            for g in np.unique(group):
                first, last = np.searchsorted(group, [g, g + 1])
                row, pos, lane = placed_bases(bounds[:-1], bounds[1:], data, each[first:last])
                tile = pos // chunk
                pair, at = _pairs(where[row], tile)
                place = (at * chunk + pos % chunk) * width + lane
                size = chunk * width
                if len(pair) * size <= DENSE * len(place):  # counted in place, without a sort
                    each_tile = np.bincount(place, minlength=len(pair) * size).reshape(len(pair), size)
                    parts = [(slice(None), row) for row in each_tile]
                else:
                    place, n = np.unique(place, return_counts=True)
                    cuts = np.searchsorted(place, np.arange(len(pair) + 1) * size)
                    parts = [(place[a:b] - k * size, n[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                for (c, t), (where_to, counted) in zip(pair, parts, strict=True):
                    key = contigs[c], int(t)
                    if key not in tiles:
                        if len(tiles) == MOST_TILES:
                            yield sent()
                        tiles[key] = np.zeros(size, np.int64)
                    tiles[key][where_to] += counted
        if tiles:
            yield sent()

    usable = reads.where("chr <> '*' and pos >= 1 and cigar <> '*' and seq <> '*' and seq <> ''")
    taken = usable.select("chr", "pos", "cigar", "seq", *([F.col(carry).cast("long")] if carry else []))
    return taken.mapInArrow(fill, SCHEMA + (", carried long" if carry else ""))


def tile_counts(reads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, chunk, counts) of reads (chr, pos, cigar, seq): for each base under M, = and X, and each deleted position, one in its lane.
    Skipped regions are passed over; insertions and clips cover no position; reads on contig `*`, without a place, a cigar or bases
    cover none. A tile of which a task has many reads is one row of that task, whatever the depth; a task that meets more than
    MOST_TILES tiles sends those it has, and goes on."""

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros((chunk, len(LANES)), np.int64)
        for blob in table["counts"]:
            total += unpack(blob.as_py(), chunk)
        return pa.table({"chr": table["chr"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "counts": pa.array([pack(total.reshape(-1))], pa.binary())})

    return partial_counts(reads, chunk).groupBy("chr", "chunk").applyInArrow(added, SCHEMA)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers, and which one each is."""
    low = int(b.min()) if len(b) else 0
    width = (int(b.max()) if len(b) else 0) - low + 1
    keys = a * width + (b - low)
    if len(keys) and (int(a.max()) + 1) * width <= DENSE * len(keys):
        there = np.bincount(keys) > 0
        keys, at = np.flatnonzero(there), (np.cumsum(there) - 1)[keys]
    else:
        keys, at = np.unique(keys, return_inverse=True)
    return np.stack([keys // width, keys % width + low], 1), at


def _rows(tiles: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from make(batch.slice(k, 1))

    return tiles.mapInArrow(run, schema)


def _named(n: int, chr: str) -> pa.Array:
    return pa.array([chr], pa.string()).take(pa.array(np.zeros(n, np.int32)))


_BASES = pa.array(list(LANES), pa.string())


def pileup_rows(tiles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, pos, base, n) of tiles."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = unpack(row.column(2)[0].as_py(), chunk)
        at, lane = np.nonzero(counts)
        first = row.column(1)[0].as_py() * chunk + 1
        yield pa.record_batch([_named(len(at), row.column(0)[0].as_py()), pa.array(at + first), _BASES.take(pa.array(lane)), pa.array(counts[at, lane])], ["chr", "pos", "base", "n"])

    return _rows(tiles.select("chr", "chunk", "counts"), "chr string, pos long, base string, n long", make)


def consensus_rows(tiles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, pos, base, depth) of tiles: the base with the largest count; ties go to the first of LANES."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = unpack(row.column(2)[0].as_py(), chunk)
        depth = counts.sum(1)
        at = np.flatnonzero(depth)
        first = row.column(1)[0].as_py() * chunk + 1
        yield pa.record_batch([_named(len(at), row.column(0)[0].as_py()), pa.array(at + first), _BASES.take(pa.array(counts[at].argmax(1))), pa.array(depth[at])], ["chr", "pos", "base", "depth"])

    return _rows(tiles.select("chr", "chunk", "counts"), "chr string, pos long, base string, depth long", make)


def patch_rows(tiles: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, pos, ref, alt) where the consensus of tiles differs from the reference, chunks (chr, chunk, bases) of the same length; the
    reference is N where it has no base. A tile meets one chunk, not its positions."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = unpack(row.column(2)[0].as_py(), chunk)
        at = np.flatnonzero(counts.sum(1))
        bases = (row.column(3)[0].as_py() or "").encode("ascii", "replace").ljust(chunk, b"N")[:chunk]
        ref = np.frombuffer(bases, np.uint8)[at]
        alt = np.frombuffer(LANES.encode(), np.uint8)[counts[at].argmax(1)]
        at, ref, alt = (x[ref != alt] for x in (at, ref, alt))
        first = row.column(1)[0].as_py() * chunk + 1
        shown = lambda x: pa.array([chr(c) for c in x.tolist()], pa.string())
        yield pa.record_batch([_named(len(at), row.column(0)[0].as_py()), pa.array(at + first), shown(ref), shown(alt)], ["chr", "pos", "ref", "alt"])

    met = tiles.join(chunks.select("chr", "chunk", "bases"), ["chr", "chunk"], "left").select("chr", "chunk", "counts", "bases")
    return _rows(met, "chr string, pos long, ref string, alt string", make)
