"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import TokenHashes, batches, materialize, mix, utf8

#: Counting buckets, as a power of two.
BITS = 16
#: Share of the trusted documents set aside for the threshold that may fall below it.
LOSS = 0.002
#: Bins into which the values are counted that may hold a percentile.
PERCENTILE_BINS = 4096
WINDOW = 8
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def base_features(data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text's UTF-8 bytes."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        windows = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            windows = mix(windows, hashes[i : len(words) - WINDOW + 1 + i])
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        if len(counts) < len(windows):
            edges = np.zeros(len(words) + 1, np.int64)
            twice = np.flatnonzero(counts[where] > 1)
            edges[twice] += 1
            edges[twice + WINDOW] -= 1
            repeated = int(np.count_nonzero(np.cumsum(edges)[:-1]))
    return (
        len(words),
        len(data.translate(None, SPACE).decode()),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of a text's word unigrams and bigrams."""
    grams = np.concatenate([mix(hashes, 1), mix(hashes[:-1], hashes[1:])])
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, n) over all documents: each task sums its own documents in one array."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches(rows):
            tokens = TokenHashes()
            found = [buckets(tokens.of(data.split()), bits) for data in utf8(batch.column(0))]
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "n": total[at]})

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, calibrates): all trusted labels; by a hash of the id, half teach the target and half set the threshold."""
    return (
        labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
        .select("doc_id")
        .distinct()
        .withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)
    )


#: The former name; nothing is sampled.
trusted_sample = trusted_labels


def percentile(values: DataFrame, column: str, share: float, bins: int = PERCENTILE_BINS) -> float | None:
    """The exact percentile of a written column, as F.percentile gives it, without one task that holds all distinct values: values
    are counted in bins, then those of the bin with the wanted ranks in finer ones, until it has one value or ends between the ranks."""
    value = F.col(column)
    own = values.where(value.isNotNull()).select(column)
    n, low, high = own.agg(F.count("*"), F.min(value), F.max(value)).first()
    if not n:
        return None
    rank, below = share * (n - 1), 0
    lower, upper = math.floor(rank), math.ceil(rank)
    while low < high:
        place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        inside = own.where((value >= low) & (value <= high)).groupBy(place.alias("bin"))
        counted = sorted(inside.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect())
        ends = below + np.cumsum([r["n"] for r in counted])
        first, last = (int(np.searchsorted(ends, k, side="right")) for k in (lower, upper))
        if first != last:  # the ranks are neighbours: the last of a bin and the first of the next
            low, high = counted[first]["high"], counted[last]["low"]
            return (upper - rank) * low + (rank - lower) * high
        below = int(ends[first]) - counted[first]["n"]
        low, high = counted[first]["low"], counted[first]["high"]
    return low


def log_ratios(target: DataFrame, raw: DataFrame, bits: int = BITS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; both multinomials with one added to each count.
    Two arrays of 2**bits numbers are all that reaches the driver."""
    out = []
    for counts in (target, raw):
        n = np.ones(1 << bits)
        for row in counts.toPandas().itertuples(index=False):
            n[row.bucket] += row.n
        out.append(np.log(n) - np.log(n.sum()))
    return out[0] - out[1]


def quality_rules(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, loss: float = LOSS) -> DataFrame:
    """doc_id, the base counts, base_failed, llr, threshold and kept for each row of `docs`.

    llr is the mean log-likelihood ratio of a text's hashed word unigrams and bigrams between trusted documents
    and the whole corpus. Half of all trusted labels is the target; the `loss` quantile of the other half is
    the threshold. A text with no words has llr 0. Null texts have no words; repeated rows are
    scored alike; with no trusted labels every text that passes the base rules is kept.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    # always joined by a shuffle, so that the work grows evenly: the ids grow with the corpus, and no task holds them all
    trusted = materialize(trusted_labels(labels), "quality-trusted").hint("merge")
    target = texts.join(trusted.where("not calibrates"), "doc_id")
    ratios = log_ratios(bucket_counts(target, bits), bucket_counts(texts, bits), bits)
    table = spark.sparkContext.broadcast(ratios)  # 2**bits numbers

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            tokens = TokenHashes()
            out = []
            for data in utf8(batch.column("text")):
                words = data.split()
                hashes = tokens.of(words)
                llr = float(table.value[buckets(hashes, bits)].mean()) if words else 0.0
                out.append((*base_features(data, words, hashes), llr))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
            columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else dict.fromkeys(names, ())
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id").cast(pa.int64())}
                | {k: pa.array(v, pa.float64() if k == "llr" else pa.int64()) for k, v in columns.items()}
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    scored = materialize(texts.mapInArrow(score, schema), "quality-scores")
    held = scored.where("n_words >= 20").join(trusted.where("calibrates"), "doc_id").select("llr")
    threshold = percentile(materialize(held, "quality-held"), "llr", loss)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return (
        scored.withColumn("base_failed", failed)
        .withColumn("threshold", F.lit(threshold).cast("double"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.coalesce("threshold", F.lit(float("-inf")))))
    )
