"""Product codes of vectors: codebooks by rounds of exact integer averaging, nearest entries by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches, hot_keys, join_hot, materialize

#: Parts of a vector, entries of a part's codebook, rounds of averaging, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are worked on at a time, and those of near norms that look at the same entries.
ROWS, GROUP = 8192, 256
#: An annulus is widened by this share of its norms, so that rounded roots never leave out an entry.
SLACK = 1e-9


@dataclass(frozen=True)
class Codebook:
    """Entries of one part position, and their places and norms in ascending order of norm."""

    entries: np.ndarray
    order: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        norms = norms_of(entries)
        order = np.argsort(norms, kind="stable")
        return cls(entries, order, norms[order])

    def nearest(self, parts: np.ndarray, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry, the first among equals, and its squared distance, which is exact.

        An entry at distance d has a norm within d of the part's norm. So the parts and the entries are sorted by norm; a group
        of parts begins with the entries around its norms, and each part's best distance tells, by binary search, the annulus that can still
        hold a better or equal one. The annulus, its ends included, is evaluated in steps that double, the best distance narrowing it
        in between. `looked` gets the number of distances taken.
        """
        n, k = len(parts), len(self.norms)
        exact = exact_type(parts, self.entries)
        sorted_entries = self.entries[self.order].astype(exact)
        entry_squares = (sorted_entries * sorted_entries).sum(1)
        norms = norms_of(parts)
        by_norm = np.argsort(norms, kind="stable")
        code, error = np.zeros(n, np.int64), np.zeros(n, np.int64 if exact is np.float64 else object)
        for begin in range(0, n, GROUP):
            rows = by_norm[begin : begin + GROUP]
            x, own = parts[rows].astype(exact), norms[rows]
            squares = (x * x).sum(1)
            best = np.full(len(rows), -1, squares.dtype)
            place = np.full(len(rows), k, np.int64)
            active = np.arange(len(rows))

            def look(a: int, b: int) -> None:
                if a >= b:
                    return
                d = squares[active, None] + entry_squares[a:b] - 2 * (x[active] @ sorted_entries[a:b].T)  # noqa: B023
                if looked is not None:
                    looked.append(d.size)
                least = d.min(1)
                first = np.where(d == least[:, None], self.order[a:b], k).min(1)
                held = best[active]  # noqa: B023
                better = (held < 0) | (least < held) | ((least == held) & (first < place[active]))  # noqa: B023
                best[active[better]], place[active[better]] = least[better], first[better]  # noqa: B023

            at = np.searchsorted(self.norms, own)
            low, high = max(0, int(at.min()) - 4), min(k, int(at.max()) + 4)
            look(low, high)
            step = 16
            while True:
                reach = np.sqrt(best.astype(np.float64))
                slack = SLACK * (own + reach)
                a = np.searchsorted(self.norms, own - reach - slack, "left")
                b = np.searchsorted(self.norms, own + reach + slack, "right")
                active = np.flatnonzero((a < low) | (b > high))
                if not len(active):
                    break
                to_low = max(int(a[active].min()), low - step) if low else low
                to_high = min(int(b[active].max()), high + step)
                look(min(to_low, low), low)
                look(high, max(to_high, high))
                low, high, step = min(to_low, low), max(to_high, high), 2 * step
            code[rows], error[rows] = place, best
        return code, error


def norms_of(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors.astype(np.float64)
    return np.sqrt((scaled * scaled).sum(1))


def exact_type(*vectors: np.ndarray) -> type:
    """Floats, where squared distances of such integers are exact in them; else Python's integers."""
    largest = max((max(abs(int(v.max())), abs(int(v.min()))) for v in vectors if v.size), default=0)
    return np.float64 if 4 * max(1, vectors[0].shape[1]) * (largest + 1) ** 2 < 1 << 53 else object


def integers(column: pa.Array, dimension: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their components as integers floor(scale * x), filled with zeros up to `dimension`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.asarray(column.is_valid())
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls as NaN
    row = np.repeat(np.arange(len(column)), lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(column)) > 0
    keep = there & ~bad
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = keep[row]
    scaled = np.floor(scale * values[use])
    wide = scaled.size and np.abs(scaled).max() >= 1 << 62
    out = np.zeros((len(column), dimension), object if wide else np.int64)
    out[row[use], place[use]] = [int(v) for v in scaled] if wide else scaled.astype(np.int64)
    return np.flatnonzero(keep), out[keep]


def finite(vector: str) -> F.Column:
    """The vector is there, without null or non-finite components."""
    x = F.col(vector)
    bound = F.lit(float("inf"))
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < bound)), F.lit(False))


@dataclass(frozen=True)
class Codes:
    """Final codebooks, by part, and the coded vectors: id, code, error, label_error."""

    codebooks: list[np.ndarray]
    rows: DataFrame

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.codebooks for v in book.reshape(-1)).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers of the entries that a code names."""
        places = bytes.fromhex(code)
        return [int(v) for book, k in zip(self.codebooks, places, strict=True) for v in book[k]]


def averages(vectors: DataFrame, books: list[Codebook], dimension: int, scale: int) -> list[np.ndarray]:
    """Codebooks after a round: each entry is the floor of the mean of the parts that are nearest to it. A task adds up its own parts;
    what it sends is a row for each entry, however many vectors it has, and the sums are as few."""
    width = dimension // len(books)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), max(len(b.entries) for b in books)), np.int64)
        sums = np.zeros((*counts.shape, width), object)  # of any size
        for batch in batches(rows, ROWS):
            _, found = integers(batch.column(0), dimension, scale)
            for p, book in enumerate(books):
                own = found[:, p * width : (p + 1) * width]
                code, _ = book.nearest(own)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(own[order], first, axis=0)
                    counts[p] += np.bincount(code, minlength=counts.shape[1])
        p, k = np.nonzero(counts)
        each = [[p.astype(np.int32), k.astype(np.int32), counts[p, k]]]
        total = sums[p, k]
        at = pa.array(np.tile(np.arange(width, dtype=np.int32), len(p)))
        spread = [np.repeat(x, width) for x in each[0]]
        yield pa.record_batch([*map(pa.array, spread), at, pa.array([str(v) for v in total.reshape(-1)], pa.string())], ["part", "entry", "n", "at", "total"])

    sent = vectors.select("_vector").mapInArrow(run, "part int, entry int, n long, at int, total string")
    added = sent.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.entries.copy() for b in books]
    for r in added.collect():  # one row for each component of the codebooks
        mean = int(r["total"]) // r["n"]
        if out[r["part"]].dtype != object and abs(mean) >= 1 << 62:
            out[r["part"]] = out[r["part"]].astype(object)
        out[r["part"]][r["entry"], r["at"]] = mean
    return out


def compress_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codes:
    """Codes of all vectors by product codebooks that are learned from all of them.

    Left out are rows whose vector is null or has a null or non-finite component. Components become integers floor(scale * x); all that
    follows is exact. The codebooks begin with the `entries` rows of smallest id (equal ids by their vectors, null ids last); with fewer rows
    they are as short. Equal distances go to the lower entry; entries that no part is nearest to stay. A vector of another length than the
    longest is filled up with zeros, and so is the longest up to a multiple of `parts`. Repeated rows are coded one by one, equal labels
    are summed over all of them, null labels together. Other columns are left out; an empty table gives no rows and empty codebooks. A squared
    distance beyond a long is an error.

    The driver holds the codebooks (entries times dimension integers), never vectors of unbounded number.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    kept = vectors.where(finite(vector)).select(F.col(id).alias("_id"), F.col(vector).alias("_vector"), F.col(label).alias("_label"))
    longest = kept.agg(F.max(F.size("_vector"))).first()[0] or 0
    dimension = -(-longest // parts) * parts
    width = dimension // parts
    first = kept.select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").toArrow()
    _, start = integers(first.column(0), dimension, scale)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        books = averages(kept, [Codebook.of(b) for b in books], dimension, scale)
    final = [Codebook.of(b) for b in books]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, ROWS):
            _, found = integers(batch.column(1), dimension, scale)
            if not len(found):
                continue
            nearest = [book.nearest(found[:, p * width : (p + 1) * width]) for p, book in enumerate(final)]
            codes = np.stack([c for c, _ in nearest], 1).astype(np.uint8)
            errors = sum(e.astype(object) for _, e in nearest)
            yield pa.record_batch([batch.column(0), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array([int(e) for e in errors], pa.int64()), batch.column(2)], ["_id", "code", "error", "_label"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = materialize(kept.mapInArrow(run, f"_id {kinds['_id']}, code string, error long, _label {kinds['_label']}"), "vector-codes")
    keyed = coded.select(F.col("_id").alias(id), "code", "error", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit("")).alias("_key"))
    sums = keyed.groupBy("_key").agg(F.sum("error").alias("label_error"))
    joined = join_hot(keyed, sums, "_key", hot_keys(keyed, "_key", keyed.count()))
    return Codes(books, joined.select(id, "code", "error", "label_error"))
