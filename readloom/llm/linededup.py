"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint and count arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from readloom.llm.common import mix, pack, shard_bounds, side, text_bytes, unpack, utf8, with_block

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Stands for a null doc_id, below all others.
NULL_ID = -(1 << 63)
GAMMA = 2.0


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """A lower-cased line's key, or None if it is shorter than `min_chars` code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


class PerfectHash:
    """A minimal perfect hash of 64-bit values in the cascading bit-array form: a value that has a bit of level l
    for itself ends there, the others go on to level l + 1; a value's index is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(values, np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> PerfectHash:
        """`values` must be distinct."""
        sizes, bits, left = [], [], values
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = cls.place(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(hits == 1)
            left = left[hits[at] > 1]
        return cls(sizes, np.concatenate([np.zeros(0, bool), *bits]))

    def index(self, values: np.ndarray) -> np.ndarray:
        """Index of each value; -1 for some values that were not in the set, an arbitrary index for others."""
        out = np.full(len(values), -1, np.int64)
        left, offset = np.arange(len(values)), 0
        for level, size in enumerate(self.sizes):
            at = self.place(values[left], level, size) + offset
            there = self.bits[at]
            out[left[there]] = self.ranks[at[there]]
            left = left[~there]
            offset += size
        return out


class LineIndex:
    """A shard's distinct line hashes: a perfect hash and the arrays that it indexes, a fingerprint, how many documents hold the
    line (counted up to `min_docs`) and the last of them. Lines whose mixed 64-bit values are equal, though their hashes
    differ, are in a dictionary instead."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, min_docs: int):
        """From entries (line hash in two halves, document), each of which may be repeated."""
        order = np.lexsort((doc, lo, hi))
        lo, hi, doc = lo[order], hi[order], doc[order]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        values = mix(lo, hi)
        ranked = np.sort(values[new])
        self.shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        self.apart: dict[tuple[int, int], tuple[int, int]] = {}
        alone = ~np.isin(values, self.shared)
        for i in np.flatnonzero(~alone).tolist():
            key = int(lo[i]), int(hi[i])
            self.apart[key] = min(min_docs, self.apart.get(key, (0, 0))[0] + int(fresh[i])), int(doc[i])
        self.hash = PerfectHash.build(values[new & alone])
        size = np.count_nonzero(new & alone)
        self.prints, self.last = np.zeros(size, np.uint64), np.full(size, NULL_ID, np.int64)
        self.counts = np.zeros(size, np.uint8 if min_docs < 256 else np.int64)
        at = self.hash.index(values[alone])
        self.prints[at] = lo[alone]
        self.counts[:] = np.minimum(np.bincount(at[fresh[alone]], minlength=size), min_docs)
        np.maximum.at(self.last, at, doc[alone])

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each line, up to min_docs, and the last; 0 for lines that the index lacks."""
        values = mix(lo, hi)
        at = self.hash.index(values)
        known = (at >= 0) & (len(self.prints) > 0)
        at = np.where(known, at, 0)
        known[known] = self.prints[at[known]] == lo[known]
        counts = np.where(known, self.counts[at] if len(self.counts) else 0, 0)
        last = self.last[at] if len(self.last) else np.full(len(at), NULL_ID)
        for i in np.flatnonzero(np.isin(values, self.shared)).tolist():
            counts[i], last[i] = self.apart.get((int(lo[i]), int(hi[i])), (0, NULL_ID))
        return counts, last


def entries(table: pa.Table, min_chars: int, min_docs: int) -> tuple[np.ndarray, ...]:
    """A block's (lo, hi, first, doc): distinct line hashes in order of (hi, lo), where the documents of each begin, and
    of those the `min_docs` last distinct ones, which is all that counts."""
    keys: list[bytes] = []
    docs: list[int] = []
    for doc, data in zip(table["doc_id"].to_pylist(), utf8(table["text"]), strict=True):
        found = {xxhash.xxh3_128_digest(k) for k in (line_key(x, min_chars) for x in data.lower().split(b"\n")) if k is not None}
        keys += found
        docs += [NULL_ID if doc is None else doc] * len(found)
    both, doc = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), np.array(docs, np.int64)
    order = np.lexsort((~doc, both[:, 0], both[:, 1]))  # ~ turns the order around
    lo, hi, doc = both[order, 0], both[order, 1], doc[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    lo, hi, doc, new = lo[fresh], hi[fresh], doc[fresh], new[fresh]
    begin = np.flatnonzero(new)
    rank = np.arange(len(new)) - np.repeat(begin, np.diff(np.append(begin, len(new))))
    keep = rank < min_docs
    lo, hi, doc, new = lo[keep], hi[keep], doc[keep], new[keep]
    begin = np.flatnonzero(new)
    return lo[begin], hi[begin], begin, doc


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def loose(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped added; columns of these names are replaced, others kept.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least `min_chars`
    code points in at least `min_docs` documents lose their lines except in the largest doc_id that holds them. Rows of one
    doc_id are one document for `min_docs`, and all keep the line if theirs is the largest id; null ids are one document that sorts
    below all others. Null and empty texts are one empty line; an empty table gives no rows.

    Documents are dealt into blocks, line hashes of 128 bits into shards. A block sends each shard its distinct hashes
    with the last `min_docs` documents of each, so a line that all documents share is one entry a block. A shard loads them
    once into its index over all distinct hashes, whose arrays the blocks' hashes then probe; answers are the lines to
    drop and who keeps them. The perfect hash takes the whole hash and the fingerprint checks half of it.
    """
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    docs = docs.select(names)
    n = side(text_bytes(docs))
    key = "_block"
    while key in names:
        key += "_"
    blocked = with_block(docs, "doc_id", n, name=key)
    bounds = shard_bounds(n)

    def ask(table: pa.Table) -> pa.Table:
        lo, hi, first, doc = entries(table, min_chars, min_docs)
        cuts = [0, *np.searchsorted(hi, bounds).tolist(), len(hi)]
        ends = np.append(first, len(doc))
        out: dict[str, list] = {"shard": [], "lo": [], "hi": [], "n": [], "docs": []}
        for shard, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if e > b:
                values = (shard, squeezed(lo[b:e]), pack(hi[b:e]), squeezed(np.diff(ends[b : e + 1]).astype("<u4")), squeezed(doc[ends[b] : ends[e]]))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        block = pa.array([table[key][0].as_py()] * len(out["shard"]), pa.int32())
        return pa.table({"from": block} | {k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in out.items()})

    def answer(table: pa.Table) -> pa.Table:
        asked = [(loose(r["lo"], "<u8"), unpack(r["hi"]), loose(r["n"], "<u4"), loose(r["docs"], "<i8")) for r in table.to_pylist()]
        times = np.concatenate([x[2] for x in asked])
        index = LineIndex(*(np.repeat(np.concatenate([x[k] for x in asked]), times) for k in (0, 1)), np.concatenate([x[3] for x in asked]), min_docs)
        out: dict[str, list] = {"block": [], "lo": [], "hi": [], "last": []}
        for block, (lo, hi, _, _) in zip(table["from"].to_pylist(), asked, strict=True):
            counts, last = index.probe(lo, hi)
            drop = counts >= min_docs
            if drop.any():
                for column, value in zip(out.values(), (block, squeezed(lo[drop]), squeezed(hi[drop]), squeezed(last[drop])), strict=True):
                    column.append(value)
        return pa.table({k: pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in out.items()})

    def rewrite(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        last: dict[bytes, int] = {}
        for r in answers.to_pylist():
            both = np.stack([loose(r["lo"], "<u8"), loose(r["hi"], "<u8")], axis=1).tobytes()
            last.update(zip((both[i : i + 16] for i in range(0, len(both), 16)), loose(r["last"], "<i8").tolist(), strict=True))
        kept, n_lines, gone = [], [], []
        for doc, data in zip(table["doc_id"].to_pylist(), utf8(table["text"]), strict=True):
            doc = NULL_ID if doc is None else doc
            lines = data.split(b"\n")
            found = ((x, line_key(x.lower(), min_chars)) for x in lines)
            stay = [x for x, k in found if k is None or last.get(xxhash.xxh3_128_digest(k), doc) == doc] if last else lines
            kept.append(b"\n".join(stay).decode())
            n_lines.append(len(lines))
            gone.append(len(lines) - len(stay))
        added = {"kept_text": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
        return pa.table([*(table[c] for c in names), *added.values()], names=[*names, *added])

    answers = (
        blocked.groupBy(key)  # with all columns, so that one exchange of the texts serves both
        .applyInArrow(ask, "from int, shard int, lo binary, hi binary, n binary, docs binary")
        .groupBy("shard")
        .applyInArrow(answer, "block int, lo binary, hi binary, last binary")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (
        blocked.groupBy(key)
        .cogroup(answers.groupBy("block"))
        .applyInArrow(rewrite, f"{schema}, kept_text string, n_lines long, n_dropped long")
    )
