"""Reference lookup, per-position counts of bases, consensus and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.alignment import base_lane, parse_cigar, placed, ref_span

#: Reference bases in one row.
CHUNK = 1 << 12


def reference_chunks(contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chr, chunk, bases) of contigs (chr, seq); upper case. For contigs that fit a cell; fasta_chunks reads those of files without one. A
    contig is cut in one pass over it."""
    cut = F.posexplode(F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    return contigs.where("seq <> ''").select("chr", cut.alias("chunk", "bases")).withColumn("chunk", F.col("chunk").cast("long"))


def contig_digests(contigs: DataFrame) -> DataFrame:
    """(chr, length, md5) of contigs (chr, seq); the digest is of the bases in upper case."""
    return contigs.select("chr", F.length("seq").cast("long").alias("length"), F.md5(F.upper("seq")).alias("md5"))


def with_reference(reads: DataFrame, chunks: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds `ref`: the reference bases from a read's start to its end, N where the reference has none. A read meets the
    chunks it lies on, not single bases; rows without a span or on contig `*` have an empty ref."""
    start, end = F.col("pos") - 1, F.col("end_excl")
    wanted = reads.where((F.col("chr") != "*") & (end > start)).select(
        *keys, "chr", "pos", "end_excl", F.explode(F.sequence(F.floor(start / chunk), F.floor((end - 1) / chunk))).alias("chunk")
    )
    whole = F.rpad(F.coalesce("bases", F.lit("")), chunk, "N")
    parts = wanted.join(chunks, ["chr", "chunk"], "left").select(*keys, "pos", "end_excl", "chunk", whole.alias("bases"))
    joined = parts.groupBy(*keys, "pos", "end_excl").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["bases"]), "")
    joined = joined.select(*keys, text.alias("text"), F.col("pos").alias("at"), F.col("end_excl").alias("to"), F.col("parts")[0]["chunk"].alias("first"))
    cut = joined.select(*keys, F.expr(f"substring(text, cast(at - first * {chunk} as int), cast(to - at + 1 as int))").alias("ref"))
    return reads.join(cut, keys, "left").withColumn("ref", F.coalesce("ref", F.lit("")))


def reference_base(positions: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds `ref` to rows (chr, pos): the base there, N where the reference has none."""
    keyed = positions.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk))
    base = F.expr(f"substring(bases, cast((pos - 1) % {chunk} as int) + 1, 1)")
    return keyed.join(chunks, ["chr", "chunk"], "left").withColumn("ref", F.when(F.coalesce(base, F.lit("")) == "", F.lit("N")).otherwise(base)).drop("chunk", "bases")


def with_spans(reads: DataFrame) -> DataFrame:
    """Adds ops, ref_span and end_excl to reads with a cigar."""
    return reads.withColumn("ops", parse_cigar(F.col("cigar"))).withColumn("ref_span", ref_span(F.col("ops"))).withColumn("end_excl", F.col("pos") - 1 + F.col("ref_span"))


def aligned_bases(reads: DataFrame) -> DataFrame:
    """(chr, pos, base): a row for each base under M, = and X, and `.` for each deleted position. Skipped regions (N) are
    passed over; insertions and clips cover no position."""
    each = reads.where("chr <> '*'").select("chr", "pos", "seq", F.explode(placed(F.col("ops"))).alias("p"))
    each = each.where(F.col("p.op").isin(*"M=XD") & (F.col("p.len") > 0))
    named = F.split(F.upper(F.expr("substring(seq, cast(p.read + 1 as int), cast(p.len as int))")), "")
    shown = F.when(F.col("p.op") == "D", F.array_repeat(F.lit("."), F.col("p.len").cast("int"))).otherwise(named)
    spread = each.select("chr", (F.col("pos") + F.col("p.ref")).alias("first"), F.posexplode(shown).alias("i", "base"))
    return spread.select("chr", (F.col("first") + F.col("i")).alias("pos"), "base")


def pileup(bases: DataFrame) -> DataFrame:
    """(chr, pos, base, n): partial counts are made before the shuffle, so deep positions are not hot."""
    known = F.when(base_lane(F.col("base")) == 5, F.lit("N")).otherwise(F.upper("base"))
    return bases.groupBy("chr", "pos", known.alias("base")).agg(F.count("*").alias("n"))


def most_frequent(base: Column, n: Column) -> Column:
    """The base with the largest count; ties go to the first of `.ACGTN`."""
    return F.max_by(base, F.struct(n, -base_lane(base)))


def consensus(counts: DataFrame) -> DataFrame:
    """(chr, pos, base, depth)."""
    return counts.groupBy("chr", "pos").agg(most_frequent(F.col("base"), F.col("n")).alias("base"), F.sum("n").alias("depth"))


def patches(consensus_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chr, pos, ref, alt) where the consensus differs from the reference."""
    with_ref = reference_base(consensus_rows.select("chr", "pos", F.col("base").alias("alt")), chunks)
    return with_ref.where("alt <> ref").select("chr", "pos", "ref", "alt")


def patched_base(positions: DataFrame, patch_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds `base` to rows (chr, pos): the patch, else the reference base, else N."""
    with_ref = reference_base(positions, chunks)
    return with_ref.join(patch_rows.select("chr", "pos", "alt"), ["chr", "pos"], "left").withColumn("base", F.coalesce("alt", "ref")).drop("alt", "ref")
