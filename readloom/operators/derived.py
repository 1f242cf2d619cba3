"""Tags that alignment and reference give: computed, left out of what is stored, restored, and compared with what files say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.compared import compared
from readloom.operators.pileup import with_reference, with_spans

#: Tags that can be computed, with the type that they are computed in.
KINDS = {"MD": "Z", "XD": "Z", "NM": "i"}


def with_derived(reads: DataFrame, chunks: DataFrame | None, keys: list[str]) -> DataFrame:
    """Adds derived, map<tag, value> of the computed tags; null for reads without bases or a place. Without a reference all its
    bases are N."""
    placed = with_spans(reads)
    if chunks is None:
        placed = placed.withColumn("ref", F.expr("repeat('N', cast(ref_span as int))"))
    else:
        placed = with_reference(placed, chunks, keys)
    seq = F.upper("seq")
    usable = (F.col("chr") != "*") & (F.col("cigar") != "*") & (F.col("seq") != "*")
    tags = placed.withColumn("_tags", compared(F.when(usable, F.col("ops")), seq, F.col("ref")))
    made = F.create_map(F.lit("MD"), F.col("_tags.md"), F.lit("XD"), F.col("_tags.xd"), F.lit("NM"), F.col("_tags.nm").cast("string"))
    return tags.withColumn("derived", F.when(F.col("_tags").isNotNull(), made)).drop("_tags", "ops", "ref", "ref_span", "end_excl")


def _same(tag: Column) -> Column:
    """The tag has the type and the value that are computed for it."""
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    known = (tag["type"] == kind[tag["tag"]]) & (tag["value"] == F.col("derived")[tag["tag"]])
    return F.coalesce(known, F.lit(False))


def elide_derived(reads: DataFrame) -> DataFrame:
    """Reads with `derived`: tags that equal it go, and elided, array<struct<pos, tag>>, tells where they stood."""
    gone = F.transform(F.filter("tags", _same), lambda t: F.struct(t["pos"].alias("pos"), t["tag"].alias("tag")))
    return reads.withColumn("elided", gone).withColumn("tags", F.filter("tags", lambda t: ~_same(t))).drop("derived")


def restore_derived(reads: DataFrame) -> DataFrame:
    """Inverse of elide_derived, for reads with `derived` and `elided`: tags stand in their old order."""
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    back = F.transform(
        "elided", lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), kind[e["tag"]].alias("type"), F.col("derived")[e["tag"]].alias("value"))
    )
    return reads.withColumn("tags", F.array_sort(F.concat("tags", back))).drop("derived", "elided")


def mismatch_counts(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., tag, present, mismatched): how many reads with `derived` have each tag that can be computed, and how many have
    another value for it. Reads that none can be computed for are left out."""
    each = reads.where("derived is not null").select(*(by or []), "derived", F.explode("tags").alias("t")).where(F.col("t.tag").isin(*KINDS))
    same = (F.col("t.value") == F.col("derived")[F.col("t.tag")])
    return each.groupBy(*(by or []), F.col("t.tag").alias("tag")).agg(F.count("*").alias("present"), F.count_if(~same).alias("mismatched"))
