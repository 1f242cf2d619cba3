"""Mate pairs: reads of one name whose mate fields can be computed from each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A read of the exact fold: its row in the block and the fields that the match looks at.
FIELDS = ("row", "chr", "pos", "span", "pchr", "ploc", "tlen")

#: Names of more reads than this are not gathered.
FEW = 256


def matches(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """The second read's mate fields, and those of the first, follow from the pair: opposite tlen, each at the other's mate
    position on the same contig, and a tlen of the first that is not negative and at most one off."""
    off = second["pos"] + first["span"] - first["pos"] - first["tlen"]
    return (
        (second["tlen"] == -first["tlen"])
        & (second["pos"] == first["ploc"])
        & (second["ploc"] == first["pos"])
        & ((first["pchr"] == "=") | (first["pchr"] == first["chr"]))
        & (first["tlen"] >= 0)
        & off.between(0, 1)
    )


def neighbour_pairs(reads: DataFrame, partition: list[str]) -> DataFrame:
    """Adds mate_row, the row of the read before of the same name if the two match, else null. Complete for names of at
    most two reads; pair_mates() follows longer chains."""
    w = Window.partitionBy(*partition, "rname").orderBy("row")
    before = {f: F.lag(f).over(w) for f in FIELDS}
    return reads.withColumn("mate_row", F.when(matches(before, {f: F.col(f) for f in FIELDS}), before["row"]))


def pair_mates(reads: DataFrame, partition: list[str], few: int = FEW) -> DataFrame:
    """(partition..., row, mate_state, mate_row, off) of all reads with a match.

    A name's reads are taken in order against one candidate: a read that matches it is its `look_back` mate and the
    candidate, which stays, is `look_ahead`; one that does not becomes the candidate. For names of at most `few` reads the fold runs
    over their sorted reads, as one aggregate, without Python. Reads of a frequent name, such as `*`, pass in order through a task that holds
    a batch of them and the candidate, and no array of them is made.
    """
    own = reads.select(*partition, "rname", *FIELDS)
    size = F.count("*").over(Window.partitionBy(*partition, "rname"))
    sized = own.withColumn("_size", size)  # a window keeps to its rows on disk where a name has many
    return both_sides(_folded(sized.where(F.col("_size").between(2, few)), partition).unionByName(_streamed(sized.where(F.col("_size") > few), partition)), partition)


def _folded(reads: DataFrame, partition: list[str]) -> DataFrame:
    """(partition..., row, mate, off) of names of few reads."""
    names = reads.groupBy(*partition, "rname").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("reads"))
    fields = lambda r: {f: r[f] for f in FIELDS}
    empty = F.array().cast("array<struct<row:bigint,mate:bigint,off:bigint>>")

    def step(acc: Column, r: Column) -> Column:
        first = acc["first"]
        found = matches(fields(first), fields(r))
        off = r["pos"] + first["span"] - first["pos"] - first["tlen"]
        pair = F.array(F.struct(r["row"].cast("bigint").alias("row"), first["row"].cast("bigint").alias("mate"), off.cast("bigint").alias("off")))
        return F.struct(F.when(found, F.concat(acc["out"], pair)).otherwise(acc["out"]).alias("out"), F.when(found, first).otherwise(r).alias("first"))

    start = F.struct(empty.alias("out"), F.col("reads")[0].alias("first"))
    folded = F.aggregate(F.slice("reads", 2, F.size("reads") - 1), start, step, lambda acc: acc["out"])
    return names.select(*partition, F.explode(folded).alias("p")).select(*partition, "p.row", "p.mate", "p.off")


def _runs(columns: dict[str, np.ndarray], first: dict[str, object] | None) -> tuple[list[np.ndarray], list[object], dict[str, object]]:
    """Stretches of reads of one name that match a candidate, the candidates, and the last of them. A candidate is compared with stretches that
    double until one has a read that does not match."""
    at, n, found, whose = 0, len(columns["row"]), [], []
    while at < n:
        if first is not None:
            width = 2
            while at < n:
                own = slice(at, min(n, at + width))
                bad = np.flatnonzero(~_match(first, {k: v[own] for k, v in columns.items()}))
                stop = at + (int(bad[0]) if len(bad) else own.stop - at)
                if stop > at:
                    found.append(np.arange(at, stop))
                    whose.append(first)
                at, width = stop, 2 * width
                if len(bad):
                    break
        if at < n:
            first = {k: v[at] for k, v in columns.items()}
            at += 1
    return found, whose, first


def _match(first: dict[str, object], second: dict[str, np.ndarray]) -> np.ndarray:
    """What matches() tells of one read and many; numbers that are missing are NaN and match nothing."""
    off = second["pos"] + first["span"] - first["pos"] - first["tlen"]
    same = first["pchr"] is not None and (first["pchr"] == "=" or first["pchr"] == first["chr"])
    return (second["tlen"] == -first["tlen"]) & (second["pos"] == first["ploc"]) & (second["ploc"] == first["pos"]) & same & (first["tlen"] >= 0) & (off >= 0) & (off <= 1)


def _streamed(reads: DataFrame, partition: list[str]) -> DataFrame:
    """The same of names of many reads, which pass in order."""
    kinds = dict(reads.dtypes)
    keys = [*partition, "rname"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            columns = {}
            for k, f in enumerate(FIELDS):
                c = batch.column(len(keys) + k)
                columns[f] = np.array(c.to_pylist(), object) if f in ("chr", "pchr") else c.to_numpy(zero_copy_only=False).astype(np.float64 if c.null_count else np.int64)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found, whose, first = _runs({f: v[a:b] for f, v in columns.items()}, first if names[a] == key else None)
                key = names[a]
                if not found:
                    continue
                at = np.concatenate(found) + a
                mate = np.repeat(np.array([w["row"] for w in whose], np.int64), [len(x) for x in found])
                base = np.repeat(np.array([w["span"] - w["pos"] - w["tlen"] for w in whose], np.int64), [len(x) for x in found])
                own = [batch.column(k).take(pa.array(at)) for k in range(len(partition))]
                yield pa.record_batch([*own, pa.array(columns["row"][at].astype(np.int64)), pa.array(mate), pa.array((columns["pos"][at] + base).astype(np.int64))], [*partition, "row", "mate", "off"])

    dealt = reads.repartition(*keys).sortWithinPartitions(*keys, "row").select(*keys, *FIELDS)
    shown = "".join(f"`{p}` {kinds[p]}, " for p in partition)
    return dealt.mapInArrow(run, shown + "row long, mate long, off long")


def both_sides(pairs: DataFrame, partition: list[str]) -> DataFrame:
    """(partition..., row, mate_state, mate_row, off) of both reads of each pair (partition..., row, mate, off); a candidate that several
    reads matched keeps the last of them."""
    back = pairs.select(*partition, "row", F.lit("look_back").alias("mate_state"), F.col("mate").alias("mate_row"), "off")
    ahead = pairs.groupBy(*partition, "mate").agg(F.max_by(F.struct("row", "off"), "row").alias("p"))
    ahead = ahead.select(*partition, F.col("mate").alias("row"), F.lit("look_ahead").alias("mate_state"), F.col("p.row").alias("mate_row"), F.col("p.off").alias("off"))
    return back.unionByName(ahead)


def drop_derivable(reads: DataFrame, pairs: DataFrame, partition: list[str]) -> DataFrame:
    """Reads with mate_state, distance and off; tlen, ploc and pchr of a `look_back` read are null, its distance tells the
    rows back to its mate."""
    back = pairs.where("mate_state = 'look_back'").select(*partition, "row", "mate_state", (F.col("row") - F.col("mate_row")).alias("distance"), "off")
    joined = reads.join(back, [*partition, "row"], "left")
    paired = F.col("distance").isNotNull()
    for name in ("tlen", "ploc", "pchr"):
        joined = joined.withColumn(name, F.when(~paired, F.col(name)))
    return joined


def rebuild_mates(stored: DataFrame, partition: list[str]) -> DataFrame:
    """Inverse of drop_derivable: mate fields of `look_back` reads from the row that many rows back."""
    mate = stored.select(*partition, (F.col("row")).alias("distance_row"), F.col("pos").alias("m_pos"), F.col("span").alias("m_span"))
    asks = stored.withColumn("distance_row", F.col("row") - F.col("distance"))
    joined = asks.join(mate, [*partition, "distance_row"], "left")
    paired = F.col("distance").isNotNull()
    tlen = -(F.col("pos") + F.col("m_span") - F.col("m_pos") - F.col("off"))
    return (
        joined.withColumn("tlen", F.when(paired, tlen).otherwise(F.col("tlen")))
        .withColumn("ploc", F.when(paired, F.col("m_pos")).otherwise(F.col("ploc")))
        .withColumn("pchr", F.when(paired, F.lit("=")).otherwise(F.col("pchr")))
        .drop("distance_row", "m_pos", "m_span", "distance", "off", "mate_state")
    )
