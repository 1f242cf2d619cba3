"""Reads and reference in buckets of the same places, so that a read meets its bases without an exchange.

Both tables are bucketed by contig and chunk of CHUNK positions. A row of the reference holds its chunk and the `reach` bases behind it, so a read of
at most `reach` bases meets one row, that of its start, and nothing has to be put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.pileup import CHUNK, with_reference

#: Bases behind a chunk that its row holds; longer reads take the way of with_reference.
REACH, BUCKETS = CHUNK, 64


def widened(chunks: DataFrame, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """(chr, chunk, bases) with the `reach` bases that follow each chunk."""
    further = -(-reach // chunk)
    parts = chunks.select("chr", "chunk", F.explode(F.sequence(F.lit(0), F.lit(further))).alias("k"), "bases")
    placed = parts.select("chr", (F.col("chunk") - F.col("k")).alias("chunk"), "k", F.rpad("bases", chunk, "N").alias("bases"), F.length("bases").alias("n")).where("chunk >= 0")
    listed = placed.groupBy("chr", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "bases", "n"))).alias("p"))  # at most further + 1
    whole = F.array_join(F.transform("p", lambda x: F.substring(x["bases"], F.lit(1), F.when(x["k"] < F.get("p", F.size("p") - 1)["k"], chunk).otherwise(x["n"]))), "")
    return listed.where(F.col("p")[0]["k"] == 0).select("chr", "chunk", F.substring(whole, 1, chunk + reach).alias("bases"))


def patched_chunks(chunks: DataFrame, patches: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, chunk, bases) with the patches (chr, pos, alt) in place: a patched reference that reads meet as they meet the plain one. Patches beyond
    a contig's end have no base to replace and are left out."""
    keyed = patches.select("chr", F.floor((F.col("pos") - 1) / chunk).alias("chunk"), ((F.col("pos") - 1) % chunk).cast("int").alias("i"), "alt")
    own = keyed.groupBy("chr", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("i", "alt"))).alias("new"))  # at most `chunk`
    joined = chunks.join(own, ["chr", "chunk"], "left")
    made = F.array_join(F.transform(F.split("bases", ""), lambda b, i: F.coalesce(F.element_at("new", i), b)), "")
    return joined.select("chr", "chunk", F.when(F.col("new").isNull(), F.col("bases")).otherwise(made).alias("bases"))


def _saved(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """`df` as a table of so many buckets, one file each, sorted inside."""
    dealt = df.repartition(buckets, "chr", "chunk").sortWithinPartitions("chr", "chunk")
    dealt.write.mode("overwrite").bucketBy(buckets, "chr", "chunk").sortBy("chr", "chunk").saveAsTable(table)
    return df.sparkSession.table(table)


def save_reference(chunks: DataFrame, table: str, buckets: int = BUCKETS, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """Saves a reference (chr, chunk, bases) as a bucketed table of widened chunks. Choose buckets so that each holds what a task can take."""
    return _saved(widened(chunks, reach, chunk), table, buckets)


def save_reads(reads: DataFrame, table: str, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Saves reads (chr, pos, end_excl, ...) as a table bucketed by the chunk of their start. Deep places make one bucket larger; what is
    stored is read in parts of a file's size, but a join takes a bucket a task, so hot places ask for more buckets."""
    return _saved(reads.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)), table, buckets)


def with_bucketed_reference(reads: DataFrame, reference: DataFrame, keys: list[str], chunks: DataFrame | None = None, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """Adds `ref` to reads of save_reads, from a reference of save_reference: the bases from a read's start to its end, N where the reference
    has none; as with_reference gives it, without an exchange. Reads longer than `reach` are an error, unless `chunks`, the plain reference, is
    given: they meet it by with_reference."""
    n = F.greatest(F.col("end_excl") - (F.col("pos") - 1), F.lit(0)).cast("int")
    given = reference.select("chr", "chunk", F.col("bases").alias("_bases"))
    short = reads if chunks is None else reads.where(F.col("end_excl") - F.col("pos") + 1 <= reach)
    at = (F.col("pos") - 1 - F.col("chunk") * chunk + 1).cast("int")
    found = F.rpad(F.substring(F.coalesce("_bases", F.lit("")), at, n), n, "N")
    found = F.when((F.col("chr") == "*") | (n == 0), "").when(n > reach, F.raise_error(F.lit("a read is longer than the reach of the reference"))).otherwise(found)
    out = short.join(given, ["chr", "chunk"], "left").select(*reads.columns, found.alias("ref"))
    if chunks is None:
        return out
    long = reads.where(F.col("end_excl") - F.col("pos") + 1 > reach)
    return out.unionByName(with_reference(long, chunks, keys, chunk).select(*reads.columns, "ref"))
