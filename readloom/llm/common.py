"""Helpers that several text operators share: byte sums, Arrow columns, token hashes, joins on keys of which a few may be
hot, and the sharded corpus counter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.storage import materialize, shared_dir, shared_path

__all__ = ["materialize", "shared_dir", "shared_path"]

#: Text bytes of the corpus for each message between a block of documents and a shard of the corpus counter.
MESSAGE_BYTES = 6 << 10
#: Text bytes of a block, and features of a shard, that are worked on at a time.
STEP_BYTES, STEP_FEATURES = 8 << 20, 4 << 20


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class TokenHashes(dict):
    """Token bytes to a 64-bit hash; each distinct token is hashed once."""

    def __missing__(self, token: bytes) -> int:
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hash of an ordered pair of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def with_block(docs: DataFrame, key: str, n_blocks: int, name: str = "block") -> DataFrame:
    """Adds `block` or another name, a number below n_blocks that follows from the key and, so that a
    repeated key cannot fill a block, from the text."""
    return docs.withColumn(name, F.pmod(F.xxhash64(key, "text"), F.lit(n_blocks)).cast("int"))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, equal bytes together."""
    deltas = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)  # a copy, to be written to


def shard_bounds(n_shards: int, bits: int = 64) -> np.ndarray:
    """First hash of each shard but the first; shards are equal ranges of hashes of so many bits, so that a sorted array is
    cut by search."""
    return (np.arange(1, n_shards, dtype=np.float64) * (2.0**bits / n_shards)).astype(np.uint64)


def side(total_bytes: int) -> int:
    """How many blocks the corpus is dealt into, and how many shards its features: the root of the messages that MESSAGE_BYTES
    allows. So messages grow in proportion to the text, and a block or shard with its root: 2.5 MB of 1 GB, 80 MB of 1 TB,
    800 MB of 100 TB."""
    return max(1, math.isqrt(total_bytes // MESSAGE_BYTES))


def hash_bits(total_bytes: int) -> int:
    """Bits of a feature's hash: two to the power of 22 times as many hashes as the corpus has bytes, up to 64 bits, so that
    a feature meets another one's hash about as rarely at any size."""
    return min(64, max(1, total_bytes).bit_length() + 22)


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of a list of texts, of about so many bytes; one, if there are no texts."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size + len(text) > limit and i > begin:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    yield begin, len(texts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of several sorted lists, sorted, and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    known, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return known, np.bincount(where, np.concatenate([c for _, c in parts]), minlength=len(known)).astype(np.int64)


def answer_shard(table: pa.Table, n_shards: int, bits: int, tally: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, step: int = STEP_FEATURES) -> pa.Table:
    """A shard's answers to what blocks asked; see corpus_counts. Its hashes are summed `step` at a time."""
    asked = [unpack(x) for x in table["hashes"].to_pylist()]
    counts = [unpack_counts(x) for x in table["counts"].to_pylist()]
    shard, size = table["shard"][0].as_py(), sum(map(len, asked))
    low, high = (float(2.0**bits / n_shards * k) for k in (shard, shard + 1))
    n_steps = max(1, -(-size // step))
    inner = [low + (high - low) * k / n_steps for k in range(1, n_steps)]
    at = [np.concatenate([[0], np.searchsorted(x, np.array(inner).astype(np.uint64)), [len(x)]]) for x in asked]
    totals: np.ndarray | int = 0
    for k in range(n_steps):  # a stretch of the shard's hashes after the other
        own = [slice(x[k], x[k + 1]) for x in at]
        known, where = np.unique(np.concatenate([x[o] for x, o in zip(asked, own, strict=True)]), return_inverse=True)
        total = np.bincount(where, np.concatenate([c[o] for c, o in zip(counts, own, strict=True)]), minlength=len(known)).astype(np.int64)
        if tally:
            totals = totals + tally(known, total)
        for c, o, w in zip(counts, own, np.split(where, np.cumsum([o.stop - o.start for o in own])[:-1]), strict=True):
            c[o] = total[w]
    out = {"block": table["from"], "shard": table["shard"], "counts": pa.array([pack_counts(c) for c in counts], pa.binary())}
    return pa.table(out | ({"tally": pa.array([pack_counts(totals)] * len(counts), pa.binary())} if tally else {}))


def corpus_counts(
    blocked: DataFrame,
    features: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    n_shards: int,
    bits: int = 64,
    tally: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Corpus-wide counts of hashed features, sent back to each block that asked.

    `features(table)` gives a block's distinct hashes of `bits` bits, sorted, and their counts there. One row
    (shard, block, hashes, counts) goes to the shard of each range of hashes. A shard sums over all
    blocks and answers each with counts in the order of its hashes, which the block knows and need not
    get back. A frequent feature is one entry a block, however often it occurs, so no key is hot.
    With as many blocks and shards as `side` gives, the rows grow in proportion to the text.
    Returns (block, shard, counts, tally): the last are numbers of the shard to add up, packed: `tally(hashes, counts)`. Every
    block asks every shard, so a block that adds these up has corpus totals.
    """
    bounds = shard_bounds(n_shards, bits)

    def ask(table: pa.Table) -> pa.Table:
        hashes, counts = features(table)
        cuts = np.searchsorted(hashes, bounds)
        parts = list(zip(np.split(hashes, cuts), np.split(counts, cuts), strict=True))
        block = table["block"][0].as_py()
        return pa.table(
            {
                "shard": pa.array(range(n_shards), pa.int32()),
                "from": pa.array([block] * n_shards, pa.int32()),
                "hashes": pa.array([pack(h) for h, _ in parts], pa.binary()),
                "counts": pa.array([pack_counts(c) for _, c in parts], pa.binary()),
            }
        )

    return (
        blocked.groupBy("block")
        .applyInArrow(ask, "shard int, from int, hashes binary, counts binary")
        .groupBy("shard")
        .applyInArrow(lambda table: answer_shard(table, n_shards, bits, tally), "block int, shard int, counts binary" + (", tally binary" if tally else ""))
    )


def answered(table: pa.Table) -> np.ndarray:
    """A block's counts, in the order of its sorted hashes."""
    rows = sorted(zip(table["shard"].to_pylist(), table["counts"].to_pylist(), strict=True))
    return np.concatenate([unpack_counts(x) for _, x in rows]) if rows else np.zeros(0, np.int64)


def hot_keys(df: DataFrame, key: str, n_rows: int, parts: int = 1000) -> DataFrame:
    """Keys that hold more than one in `parts` of the n_rows rows of `df`; there are fewer than `parts`."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > n_rows / parts).select(key)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`left` inner join `right`, which has each key at most once, by `key`. Rows of `right` of the hot keys, a bounded
    number (see hot_keys), are broadcast, so that no task gathers such a key; the other keys are shuffled."""
    hot = F.broadcast(hot)
    often = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return often.unionByName(left.join(hot, key, "left_anti").join(right, key))


def batches(rows: Iterator[pa.RecordBatch], limit: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `limit` rows."""
    for batch in rows:
        for start in range(0, max(1, batch.num_rows), limit):
            yield batch.slice(start, limit)
