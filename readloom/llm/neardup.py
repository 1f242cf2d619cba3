"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, bands, and exact weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import (
    TokenHashes,
    answered,
    corpus_counts,
    hot_keys,
    join_hot,
    materialize,
    mix,
    side,
)

#: Words in a shingle.
SHINGLE = 5
#: Bits of a shingle's hash.
HASH_BITS = 56
SIMILARITY = 0.8
#: Samples in a band, and bands: at similarity 0.8 a pair shares none with a chance of (1 - 0.8**3)**12, 2 in 10,000.
ROWS, BANDS = 3, 12
#: Members of a bucket that one task compares with as many others at once.
CHUNK = 256
#: A pair whose samples agree less often than this is not compared: five deviations below 0.8 at 36 samples.
AGREE = 0.45
NULL_ID = -(1 << 63)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of each distinct shingle of each text, sorted by both; hashes have HASH_BITS bits. A text of fewer
    than SHINGLE words, but not none, is one shingle."""
    tokens = TokenHashes()
    parts = [tokens.of(words(x)) for x in texts]
    sizes = np.array([len(x) for x in parts], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    depth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.minimum(sizes, SHINGLE)[owner]
    run = np.zeros(len(flat), np.uint64)
    for back in range(SHINGLE - 1, -1, -1):
        shifted = np.concatenate([np.zeros(min(back, len(flat)), np.uint64), flat[: max(0, len(flat) - back)]])
        run = np.where(back < length, mix(run, shifted), run)
    whole = depth >= length - 1
    owner, run = owner[whole], run[whole] >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], run[at], np.diff(np.append(at, len(run)))


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed inverse document frequency, scaled to between 1 (in every document) and 2, so that a large group of
    near copies does not lose its similarity to the low weight of what it shares."""
    top = np.log(n_docs + 1.0) or 1.0
    return 1.0 + np.maximum(0.0, np.log((n_docs + 1.0) / (df + 1.0))) / top


def sample(hashes: np.ndarray, weights: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    """n improved consistent weighted samples of a weighted set, each a hash of (element, level)."""
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64), 0x5851F42D4C957F2D)
    out, least = np.zeros(n, np.uint64), np.full(n, np.inf)
    rows = np.arange(n)
    for begin in range(0, len(hashes), 4096):  # memory does not grow with the text
        h, log_w = hashes[begin : begin + 4096], np.log(weights[begin : begin + 4096])
        base = mix(h[None, :], seeds[:, None])
        u1, u2 = _uniforms(base, 1)
        v1, v2 = _uniforms(base, 2)
        beta, _ = _uniforms(base, 3)
        r, c = -np.log(u1 * u2), -np.log(v1 * v2)
        level = np.floor(log_w / r + beta)
        value = np.log(c) - r * (level - beta) - r
        at = value.argmin(axis=1)
        better = value[rows, at] < least
        chosen = mix(h[at], level[rows, at].astype(np.int64).view(np.uint64))
        out[better], least[better] = chosen[better], value[rows, at][better]
    return out


def _uniforms(base: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(base, salt)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return ((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32, (low + 0.5) / 2**32


def bands(samples: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS samples."""
    out = np.arange(1, len(samples) // ROWS + 1, dtype=np.uint64)
    for row in samples.reshape(-1, ROWS).T:
        out = mix(out, row)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights of two sets of sorted hashes and their weights."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    x, y = a[1][at[both]], b[1][both]
    small = float(np.minimum(x, y).sum())
    return small / (float(a[1].sum()) + float(b[1].sum()) - small)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of each row of `docs`, and (digest, rep, copies) of each distinct text: its least doc_id (null
    ids below all) and its number of rows. Null texts have a null digest and no row in the second."""
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("rep"))
    reps = keyed.where("digest is not null").groupBy("digest").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"))
    return keyed.select("doc_id", "digest"), reps


def weighted_sets(docs: DataFrame, reps: DataFrame, n_docs: int, n_bytes: int) -> DataFrame:
    """(rep, samples, hashes, weights) of each distinct text that may have a partner.

    A shingle that no other text has adds to the union with any partner and to no intersection. So a text is left out,
    without loss, if shingles of other texts make up less than SIMILARITY of its weight.
    """
    n_blocks = side(n_bytes)

    def block(ident: str, digest: str) -> F.Column:
        return F.pmod(F.xxhash64(ident, digest), F.lit(n_blocks)).cast("int").alias("block")

    keyed = docs.where("text is not null").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("ident"), "text", F.unhex(F.sha2("text", 256)).alias("digest")
    )
    keyed = keyed.select("ident", "text", "digest", block("ident", "digest"))
    own = reps.select("rep", "digest", "copies", block("rep", "digest"))

    def chosen(table: pa.Table, wanted: dict[tuple[int, bytes], int]) -> tuple[list[int], list[int], list[str]]:
        """Of each distinct text in the block that is its representative: id, copies and text."""
        left, ids, copies, texts = dict(wanted), [], [], []
        for ident, digest, text in zip(table["ident"].to_pylist(), table["digest"].to_pylist(), table["text"], strict=True):
            n = left.pop((ident, digest), None) if text.is_valid else None
            if n is not None:
                ids.append(ident)
                copies.append(n)
                texts.append(text.as_py())
        return ids, copies, texts

    def ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, copies, texts = chosen(table, wanted_of(table))
        owner, hashes, _ = shingles(texts)
        found, where = np.unique(hashes, return_inverse=True)
        return found, np.bincount(where, np.array(copies, np.int64)[owner], minlength=len(found)).astype(np.int64)

    def wanted_of(table: pa.Table) -> dict[tuple[int, bytes], int]:
        mine = table.filter(pa.compute.is_null(table["text"]))
        return {
            (i, d): n for i, d, n in zip(mine["ident"].to_pylist(), mine["digest"].to_pylist(), mine["copies"].to_pylist(), strict=True)
        }

    def finish(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, copies, texts = chosen(table, wanted_of(table))
        owner, hashes, times = shingles(texts)
        known, where = np.unique(hashes, return_inverse=True)
        df = answered(answers)[where]
        weight = times * idf(df, n_docs)
        total = np.bincount(owner, weight, minlength=len(ids))
        shared = np.bincount(owner, np.where(df > np.array(copies, np.int64)[owner], weight, 0.0), minlength=len(ids))
        starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        out: dict[str, list] = {"rep": [], "samples": [], "hashes": [], "weights": []}
        for i in np.flatnonzero((shared >= SIMILARITY * total * (1 - 1e-9)) & (total > 0)):
            own_hashes, own_weights = hashes[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]
            out["rep"].append(ids[i])
            out["samples"].append(sample(own_hashes, own_weights).tobytes())
            out["hashes"].append(own_hashes.tobytes())
            out["weights"].append(own_weights.astype(np.float32).tobytes())
        return pa.table({"rep": pa.array(out["rep"], pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("samples", "hashes", "weights")})

    # one exchange of texts by block, with a block's representatives among its rows
    rows = keyed.select("block", "ident", "digest", "text", F.lit(None).cast("long").alias("copies")).unionByName(
        own.select("block", F.col("rep").alias("ident"), "digest", F.lit(None).cast("string").alias("text"), "copies")
    )
    answers = corpus_counts(rows, ask, n_blocks, HASH_BITS)
    return (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(finish, "rep long, samples binary, hashes binary, weights binary")
    )


def _groups(rows: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows, sorted by their first n_keys columns, that are equal in those."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(keys[:, begin])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def links(table: pa.Table) -> list[tuple[int, int]]:
    """Of one bucket, or of two chunks of one, pairs of at least SIMILARITY that connect what such pairs connect."""
    table = table.sort_by("rep")
    reps, chunk = table["rep"].to_pylist(), table["chunk"].to_numpy()
    samples = np.stack([np.frombuffer(x, np.uint64) for x in table["samples"].to_pylist()])
    sets = [
        (np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32).astype(np.float64))
        for h, w in zip(table["hashes"].to_pylist(), table["weights"].to_pylist(), strict=True)
    ]
    total = np.array([w.sum() for _, w in sets])
    across = len(set(chunk.tolist())) > 1
    root = np.arange(len(reps))
    out = []
    for i in range(len(reps) - 1):
        rest = slice(i + 1, None)
        near = (samples[rest] == samples[i]).mean(axis=1) >= AGREE
        near &= np.minimum(total[rest], total[i]) >= (SIMILARITY - 1e-6) * np.maximum(total[rest], total[i])
        near &= root[rest] != root[i]
        if across:
            near &= chunk[rest] != chunk[i]
        for j in np.flatnonzero(near) + i + 1:
            if root[i] != root[j] and weighted_jaccard(sets[i], sets[j]) >= SIMILARITY - 1e-7:
                root[root == root[j]] = root[i]
                out.append((reps[i], reps[j]))
    return out


def similar_pairs(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): verified pairs of representatives that connect each class of near duplicates.

    Members of one bucket are compared in one task. A bucket of more than `chunk` is dealt into chunks of about that
    size, and every two chunks, and each with itself, are compared in tasks of their own: no bucket is cut short.
    """

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [bands(np.frombuffer(x, np.uint64)).view(np.int64) for x in batch.column("samples").to_pylist()]
            yield pa.record_batch({"rep": batch.column("rep"), "bands": pa.array([x.tolist() for x in found], pa.list_(pa.int64()))})

    members = materialize(
        sets.select("rep", "samples").mapInArrow(keys, "rep long, bands array<long>").select("rep", F.explode("bands").alias("band")), "bands"
    )
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = members.join(sizes, "band").withColumn("k", F.ceil(F.col("n") / chunk))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep", "band"), F.col("k")))
    dealt = placed.select("band", "rep", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "chunk")
    full = dealt.join(sets, "rep").select("band", "i", "j", "rep", "chunk", "samples", "hashes", "weights")

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(rows, 3):
            # a pair of unlike chunks leaves pairs inside of one to that chunk's own task
            if (found := links(table)):
                a, b = zip(*found, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ordered = full.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large and small stars. The hubs that stars
    make are hot keys of the joins."""
    edges = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = None
    n_edges = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = materialize(hot_keys(both, "u", 2 * n_edges), "hubs")  # those of `large` are among them
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = join_hot(both, least, "u", hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, "u", hubs).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = materialize(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size, n_edges = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def text_classes(docs: DataFrame) -> DataFrame:
    """(digest, rep, class, copies) of each distinct text of `docs` that is not null."""
    n = docs.where("text is not null").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    _, reps = distinct_texts(docs)
    sets = materialize(weighted_sets(docs, reps, n["docs"], n["bytes"] or 0), "sets")
    classes = connected(similar_pairs(sets))
    joined = reps.join(classes, reps["rep"] == classes["node"], "left")
    return materialize(joined.select("digest", "rep", F.coalesce("label", "rep").alias("class"), "copies"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies) of each row of `docs`.

    Texts are one if they are equal; two texts are linked if the weighted Jaccard similarity of their shingles, weighed
    by times in the text and inverse document frequency, is at least SIMILARITY; a class is what links connect, and
    class_id its least doc_id. copies is how many rows have the same text. Null texts are alone in their class (of
    their doc_id); texts without words link to nothing but equal texts. Rows of one doc_id may be in several classes.
    Classes are what pairs of texts connect; pairs that add nothing to a class are not counted. A very long text is one set
    in the memory of its block; other columns are left out; an empty table gives no rows.
    """
    rows, _ = distinct_texts(docs)
    return rows.join(text_classes(docs), "digest", "left").select(
        "doc_id",
        F.coalesce(F.when(F.col("class") != NULL_ID, F.col("class")), "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each class the one with the least doc_id, once if it is repeated, and all
    rows with a null text."""
    stays = text_classes(docs).where("rep = class").select(F.col("digest").alias("_of_digest"), F.col("rep").alias("_of_rep"))
    keyed = docs.withColumn("_of_text", F.unhex(F.sha2("text", 256))).withColumn("_of_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    kept = keyed.join(stays, (F.col("_of_text") == F.col("_of_digest")) & (F.col("_of_id") == F.col("_of_rep")))
    first = F.row_number().over(Window.partitionBy("_of_text", "_of_id").orderBy(F.lit(0)))
    return kept.withColumn("_of_row", first).where("_of_row = 1").select(docs.columns).unionByName(docs.where("text is null"))
