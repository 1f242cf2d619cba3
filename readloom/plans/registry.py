"""Registered queries of the library's own operators, and the SQL that gives their rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.api import ReadStore
from readloom.functions import alignment, fields
from readloom.operators import buckets, columns, derived, mates, ordered, pileup, ranges, stats, tiles
from readloom.plans.adapters import ORDER, C, L, M, Q, R, contigs, letters, mated, qualities, reads, table
from readloom.sources import bam, fasta, sinks, store, tail, text
from readloom.storage import materialize, shared_path
from readloom.streaming import reads as streams
from readloom.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


READ = ("rname", "chr", "pos", "flag", "oid", "ln")
_READ = ", ".join(READ)

# --- filters and ranges


@query(f"WITH {R} SELECT {_READ} FROM r WHERE flag & 17 = 17")
def q_flag_include(spark, sf_dir):
    return reads(spark, sf_dir).where(ranges.include(F.col("flag"), 17)).select(*READ)


@query(f"WITH {R} SELECT {_READ} FROM r WHERE flag & 17 <> 17")
def q_flag_exclude_all(spark, sf_dir):
    return reads(spark, sf_dir).where(ranges.exclude_all(F.col("flag"), 17)).select(*READ)


@query(f"WITH {R} SELECT {_READ} FROM r WHERE flag & 17 = 0")
def q_flag_exclude_any(spark, sf_dir):
    return reads(spark, sf_dir).where(ranges.exclude_any(F.col("flag"), 17)).select(*READ)


@query(f"WITH {R} SELECT {_READ}, flag & 4 = 0 AS mapped, flag & 16 <> 0 AS reverse FROM r")
def q_flag_predicates(spark, sf_dir):
    flag = F.col("flag")
    return reads(spark, sf_dir).select(*READ, fields.is_mapped(flag).alias("mapped"), fields.is_reverse(flag).alias("reverse"))


@query(f"WITH {R} SELECT {_READ} FROM r WHERE chr = 'chr2' AND pos BETWEEN 500 AND 900")
def q_range_start(spark, sf_dir):
    (r,) = ranges.parse_ranges("chr2:500-900")
    return reads(spark, sf_dir).where(ranges.in_range(r)).select(*READ)


@query(f"WITH {R} SELECT {_READ}, end_excl FROM r WHERE chr = 'chr2' AND pos <= 900 AND (pos >= 500 OR end_excl >= 500) AND flag & 1 = 1")
def q_range_overlap(spark, sf_dir):
    (r,) = ranges.parse_ranges("chr2:900-500")
    found = reads(spark, sf_dir).where(ranges.include(F.col("flag"), 1)).where(ranges.in_range(r, overlap=True, max_ref_span=50))
    return found.select(*READ, "end_excl").orderBy("chr", "pos", "oid", "ln")


_MULTI = "chr1:100-300;chr2:200-400;chr1:250-350;chr3:2000"


@query(f"""WITH {R}, g(range_no, c, s, e) AS (VALUES (0, 'chr1', 100, 300), (1, 'chr2', 200, 400), (2, 'chr1', 250, 350), (3, 'chr3', 2000, 2147483647))
SELECT {_READ}, range_no FROM r JOIN g ON chr = c AND pos <= e AND (pos >= s OR end_excl >= s)""")
def q_multi_range(spark, sf_dir):
    df = reads(spark, sf_dir)
    return ranges.multi_range(df, ranges.ranges_frame(df, ranges.parse_ranges(_MULTI)), overlap=True, bin_size=128).select(*READ, "range_no")


_FILES = "1,chr1:100-300;chr2:200-400;0,chr1:250-350;1,chr3:2000"
_G = "g(range_no, f, c, s, e) AS (VALUES (0, 1, 'chr1', 100, 300), (1, 0, 'chr2', 200, 400), (2, 0, 'chr1', 250, 350), (3, 1, 'chr3', 2000, 2147483647))"


def _filed(df: DataFrame) -> DataFrame:
    return df.withColumn("file_id", (F.col("oid") % 2).cast("int"))


@query(f"WITH {R}, {_G} SELECT {_READ}, f AS file_id, range_no FROM r JOIN g ON chr = c AND oid % 2 = f AND pos <= e AND (pos >= s OR end_excl >= s)")
def q_multi_range_files(spark, sf_dir):
    """Ranges of two files over rows of both."""
    df = _filed(reads(spark, sf_dir))
    return ranges.multi_range(df, ranges.ranges_frame(df, ranges.parse_ranges(_FILES)), overlap=True, bin_size=128).select(*READ, "file_id", "range_no")


@query(f"WITH {R}, {_G} SELECT {_READ}, CAST(oid % 2 AS INTEGER) AS file_id FROM r WHERE EXISTS (FROM g WHERE chr = c AND oid % 2 = f AND pos <= e AND (pos >= s OR end_excl >= s))")
def q_any_range_files(spark, sf_dir):
    return ranges.any_range(_filed(reads(spark, sf_dir)), ranges.parse_ranges(_FILES), overlap=True).select(*READ, "file_id")


@query(f"""WITH {R}, {_G}, b AS (SELECT CAST(oid % 2 AS INTEGER) AS file_id, chr, (row_number() OVER (PARTITION BY oid % 2, chr ORDER BY pos, oid, ln, pk, cents) - 1) // 500 AS block_id, pos, end_excl FROM r),
i AS (SELECT file_id, chr, block_id, min(pos) AS first_pos, max(end_excl) AS last_end FROM b GROUP BY ALL)
SELECT range_no, file_id, chr, block_id FROM i JOIN g ON chr = c AND file_id = f AND first_pos <= e AND last_end >= s""")
def q_block_ranges_files(spark, sf_dir):
    blocks = ordered.assign_blocks(_filed(reads(spark, sf_dir)), ["file_id", "chr"], ["pos", "oid", "ln", "pk", "cents"], 500)
    index = columns.block_index(blocks, ["file_id", "chr"])
    return ranges.blocks_of_ranges(index, ranges.ranges_frame(index, ranges.parse_ranges(_FILES)), bin_size=128)


@query(f"""WITH {R} SELECT {_READ} FROM r WHERE (chr = 'chr1' AND pos BETWEEN 100 AND 350) OR (chr = 'chr2' AND pos BETWEEN 200 AND 400)
OR (chr = 'chr3' AND pos >= 2000)""")
def q_any_range(spark, sf_dir):
    return ranges.any_range(reads(spark, sf_dir), ranges.parse_ranges(_MULTI)).select(*READ)


@query(f"WITH {R} SELECT oid, ln, least(end_excl, 900) >= greatest(pos, 500) AS meets FROM r")
def q_closed_overlap(spark, sf_dir):
    meets = fields.closed_overlap(F.col("pos"), F.col("end_excl"), F.lit(500), F.lit(900))
    return reads(spark, sf_dir).select("oid", "ln", meets.alias("meets"))


# --- blocks

_B = f"{R}, b AS (SELECT *, (row_number() OVER (PARTITION BY chr ORDER BY pos, oid, ln) - 1) // 500 AS block_id FROM r)"
_I = f"{_B}, i AS (SELECT chr, block_id, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos, max(end_excl) AS last_end FROM b GROUP BY ALL)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.assign_blocks(reads(spark, sf_dir), ["chr"], ["pos", "oid", "ln"], 500)


@query(f"WITH {_B} SELECT oid, ln, chr, block_id FROM b")
def q_block_assign(spark, sf_dir):
    return _blocks(spark, sf_dir).select("oid", "ln", "chr", "block_id")


@query(f"WITH {_I} SELECT * FROM i")
def q_block_index(spark, sf_dir):
    return columns.block_index(_blocks(spark, sf_dir), ["chr"])


@query(f"WITH {_I} SELECT chr, block_id, n_rows FROM i WHERE chr = 'chr2' AND first_pos <= 900 AND last_end >= 500")
def q_block_prune(spark, sf_dir):
    (r,) = ranges.parse_ranges("chr2:500-900")
    return ranges.blocks_of_range(columns.block_index(_blocks(spark, sf_dir), ["chr"]), r).select("chr", "block_id", "n_rows")


@query(f"""WITH {_I}, g(range_no, c, s, e) AS (VALUES (0, 'chr1', 100, 300), (1, 'chr2', 200, 400), (2, 'chr1', 250, 350), (3, 'chr3', 2000, 2147483647))
SELECT range_no, chr, block_id FROM i JOIN g ON chr = c AND first_pos <= e AND last_end >= s""")
def q_block_ranges(spark, sf_dir):
    index = columns.block_index(_blocks(spark, sf_dir), ["chr"])
    return ranges.blocks_of_ranges(index, ranges.ranges_frame(index, ranges.parse_ranges(_MULTI)), bin_size=128)


@query(f"""WITH {_I}, a AS (SELECT DISTINCT concat('chr', o_custkey % 6) AS chr, o_custkey % 2600 AS at FROM orders)
SELECT a.chr, a.at, (SELECT max_by(i.block_id, (i.first_pos, i.block_id)) FROM i WHERE i.chr = a.chr AND i.first_pos <= a.at) AS block_id FROM a""")
def q_block_at(spark, sf_dir):
    asks = table(spark, sf_dir, "orders").selectExpr("concat('chr', o_custkey % 6) as chr", "o_custkey % 2600 as at").distinct()
    index = columns.block_index(_blocks(spark, sf_dir), ["chr"])
    last = index.groupBy("chr", "first_pos").agg(F.max("block_id").alias("block_id"))
    return ranges.block_at(last, asks)


@query(f"""WITH RECURSIVE {R}, n AS (SELECT *, row_number() OVER w AS k, CAST(sum(span) OVER w AS BIGINT) AS s FROM r
  WINDOW w AS (PARTITION BY chr ORDER BY pos, oid, ln, pk, cents ROWS UNBOUNDED PRECEDING)),
e AS MATERIALIZED (SELECT a.chr, a.k, least(a.k + 500, coalesce(b.k + 1, a.k + 500)) AS nxt FROM n a ASOF LEFT JOIN n b ON a.chr = b.chr AND a.s - a.span + 10000 <= b.s),
h AS (SELECT DISTINCT chr, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS block_id FROM n UNION ALL SELECT h.chr, e.nxt, h.block_id + 1 FROM h JOIN e ON h.chr = e.chr AND h.k = e.k)
SELECT n.chr, n.pos, n.oid, n.ln, n.span, h.block_id FROM n ASOF JOIN h ON n.chr = h.chr AND n.k >= h.k""")
def q_capped_blocks(spark, sf_dir):
    """Blocks of at most 500 rows that end when their spans reach 10,000."""
    df = reads(spark, sf_dir).select("chr", "pos", "oid", "ln", "span", "pk", "cents")
    return ordered.assign_capped_blocks(df, ["chr"], ["pos", "oid", "ln", "pk", "cents"], "span", 500, 10_000).drop("pk", "cents")


# --- statistics


@query(f"WITH {R} SELECT chr, flag, count(*) AS n FROM r GROUP BY chr, flag")
def q_flag_histogram(spark, sf_dir):
    return stats.flag_histogram(reads(spark, sf_dir), ["chr"])


@query(f"WITH {R} SELECT count(*) FILTER (flag & 48 = 48) AS included, count(*) FILTER (flag & 48 = 0) AS excluded FROM r")
def q_filtered_count(spark, sf_dir):
    return stats.filtered_count(stats.flag_histogram(reads(spark, sf_dir)), 48)


@query(f"""WITH {R} SELECT flag, count(*) AS reads, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped,
count(DISTINCT chr) AS contigs FROM r GROUP BY ROLLUP (flag)""")
def q_stats_report(spark, sf_dir):
    return stats.stats_report(reads(spark, sf_dir))


@query(f"WITH {R} SELECT chr, count(*) AS reads, max(end_excl) AS last_end, max(span) AS max_span FROM r GROUP BY chr")
def q_contig_bounds(spark, sf_dir):
    return reads(spark, sf_dir).groupBy("chr").agg(F.count("*").alias("reads"), F.max("end_excl").alias("last_end"), F.max("span").alias("max_span"))


# --- order


@query(f"""WITH {R}, f AS (SELECT chr, row_number() OVER (ORDER BY min(oid * 8 + ln)) - 1 AS chr_rank FROM r GROUP BY chr)
SELECT oid, ln, chr_rank, row_number() OVER (PARTITION BY r.chr ORDER BY pos, oid, ln) AS place FROM r JOIN f USING (chr)""")
def q_coordinate_sort(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("row_id", F.col("oid") * 8 + F.col("ln"))
    ranked = columns.coordinate_order(df, columns.first_seen_dictionary(df, [], "chr", "row_id"))
    placed = ordered.row_numbers(ranked, ["chr"], ["pos", "row_id"], "place")
    return placed.select("oid", "ln", "chr_rank", (F.col("place") + 1).alias("place"))


@query(f"WITH {R} SELECT chr, row_number() OVER (ORDER BY min(oid * 8 + ln)) - 1 AS id FROM r GROUP BY chr")
def q_first_appearance_rank(spark, sf_dir):
    return columns.first_seen_dictionary(reads(spark, sf_dir).withColumn("row_id", F.col("oid") * 8 + F.col("ln")), [], "chr", "row_id")


_D = f"""{R}, d AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY chr ORDER BY oid, ln, pk, cents, pos) AS d FROM r)"""


@query(f"WITH {_D} SELECT oid, ln, CAST(CASE WHEN d < 0 OR d >= 254 THEN 255 ELSE d END AS INTEGER) AS delta, CASE WHEN d < 0 OR d >= 254 THEN pos END AS escape FROM d")
def q_pos_delta(spark, sf_dir):
    return ordered.delta(reads(spark, sf_dir), "pos", ["chr"], ORDER).select("oid", "ln", "delta", "escape")


@query(f"WITH {R} SELECT oid, ln, pos AS value FROM r")
def q_pos_delta_inverse(spark, sf_dir):
    coded = ordered.delta(reads(spark, sf_dir), "pos", ["chr"], ORDER).withColumnRenamed("pos", "true_pos")
    return ordered.delta_inverse(coded, ["chr"], [*ORDER[:-1], "true_pos"]).select("oid", "ln", "value")


@query(f"""WITH {R}, p AS (SELECT DISTINCT chr, pos FROM r WHERE pos % 3 = 0), d AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY chr ORDER BY pos) AS d FROM p)
SELECT chr, pos, CAST(least(d, 254) AS INTEGER) AS delta, CASE WHEN d >= 254 THEN d - 253 END AS escape, pos AS again FROM d""")
def q_patch_deltas(spark, sf_dir):
    patches = reads(spark, sf_dir).where("pos % 3 = 0").select("chr", "pos").distinct()
    return ordered.patch_delta_inverse(ordered.patch_delta(patches, ["chr"]), ["chr"], ["pos"], "again")


@query(f"""WITH {R}, n AS (SELECT *, oid % 16 AS part, coalesce(chr <> lag(chr) OVER (PARTITION BY oid % 16 ORDER BY oid, ln, pk, cents, pos), false) AS new FROM r)
SELECT oid, ln, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY oid, ln, pk, cents, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM n""")
def q_chr_runs(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("part", F.col("oid") % 16)
    return ordered.run_ids(df, "chr", ["part"], ORDER).select("oid", "ln", "run_id")


@query(f"""WITH {R}, o AS (SELECT chr, pos < lag(pos) OVER (PARTITION BY chr ORDER BY oid, ln, pk, cents, pos) AS late FROM r)
SELECT chr, count(*) FILTER (late) AS n_unsorted FROM o GROUP BY chr""")
def q_sortedness(spark, sf_dir):
    return ordered.unsorted_rows(reads(spark, sf_dir), "pos", ["chr"], ORDER)


# --- mates

_MATCH = """b.tlen = -a.tlen AND b.pos = a.ploc AND b.ploc = a.pos AND (a.pchr = '=' OR a.pchr = a.chr) AND a.tlen >= 0
AND b.pos + a.span - a.pos - a.tlen BETWEEN 0 AND 1"""


@query(f"""WITH {M}, w AS (SELECT *, lag(row) OVER (PARTITION BY rname ORDER BY row) AS before FROM m)
SELECT b.oid, b.row, CASE WHEN {_MATCH} THEN a.row END AS mate_row FROM w b LEFT JOIN m a ON a.rname = b.rname AND a.row = b.before""")
def q_mate_pairs_lag(spark, sf_dir):
    return mates.neighbour_pairs(mated(spark, sf_dir), ["oid"]).select("oid", "row", "mate_row")


_FOLD = f"""{M}, n AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY row) AS k FROM m),
f AS (
  SELECT oid, k, row AS first, CAST(NULL AS BIGINT) AS mate, CAST(NULL AS BIGINT) AS off FROM n WHERE k = 1
  UNION ALL
  SELECT b.oid, b.k, CASE WHEN {_MATCH} THEN a.row ELSE b.row END, CASE WHEN {_MATCH} THEN a.row END,
         CASE WHEN {_MATCH} THEN b.pos + a.span - a.pos - a.tlen END
  FROM f JOIN n b ON b.oid = f.oid AND b.k = f.k + 1 JOIN m a ON a.oid = f.oid AND a.row = f.first)"""


@query(f"""WITH RECURSIVE {_FOLD}, p AS (SELECT f.oid, n.row, f.mate, f.off FROM f JOIN n USING (oid, k) WHERE f.mate IS NOT NULL)
SELECT oid, row, 'look_back' AS mate_state, mate AS mate_row, off FROM p
UNION ALL SELECT oid, mate, 'look_ahead', max(row), max_by(off, row) FROM p GROUP BY oid, mate""")
def q_mate_pairs(spark, sf_dir):
    return mates.pair_mates(mated(spark, sf_dir), ["oid"])


@query(f"""WITH RECURSIVE {_FOLD} SELECT f.oid, n.row, n.row - f.mate AS distance FROM f JOIN n USING (oid, k) WHERE f.mate IS NOT NULL""")
def q_mate_distance(spark, sf_dir):
    df = mated(spark, sf_dir)
    coded = mates.drop_derivable(df, mates.pair_mates(df, ["oid"]), ["oid"])
    return coded.where("distance is not null").select("oid", "row", "distance")


@query(f"WITH {M} SELECT oid, row, tlen, ploc, pchr FROM m")
def q_mate_reconstruct(spark, sf_dir):
    df = mated(spark, sf_dir)
    coded = mates.drop_derivable(df, mates.pair_mates(df, ["oid"]), ["oid"])
    return mates.rebuild_mates(coded, ["oid"]).select("oid", "row", "tlen", "ploc", "pchr")


@query(f"""WITH {M} SELECT oid, row, CASE WHEN (tlen < 0) = (flag & 16 <> 0) THEN 'ok' WHEN tlen >= 0 THEN 'greater_than_0' ELSE 'less_than_0' END AS state,
tlen AS again FROM m""")
def q_tlen_state(spark, sf_dir):
    state = fields.tlen_state(F.col("tlen"), F.col("flag"))
    again = fields.tlen_of_state(F.abs("tlen"), state, F.col("flag"))
    return mated(spark, sf_dir).select("oid", "row", state.alias("state"), again.alias("again"))


@query(f"""WITH {M} SELECT oid, row, pos + tlen + CASE WHEN tlen > 0 THEN -span ELSE span END - ploc AS residual, ploc AS again,
CASE WHEN ploc = pos OR tlen = 0 OR (ploc > pos) = (tlen > 0) THEN ploc - pos END AS away FROM m""")
def q_mate_residual(spark, sf_dir):
    args = [F.col(c) for c in ("tlen", "span", "pos")]
    residual = fields.mate_residual(*args, F.col("ploc"))
    away = fields.mate_offset(F.col("pos"), F.col("ploc"), F.col("tlen"))
    return mated(spark, sf_dir).select("oid", "row", residual.alias("residual"), fields.mate_pos_of_residual(*args, residual).alias("again"), away.alias("away"))


# --- bases

_P = f"""{L}, e AS (SELECT chr, pos + i AS pos, substr(seq, CAST(i + 1 AS INTEGER), 1) AS b FROM (SELECT *, unnest(range(len(seq))) AS i FROM l WHERE chr <> '*')),
p AS (SELECT chr, pos, CASE WHEN b IN ('A', 'C', 'G', 'T') THEN b ELSE 'N' END AS base, count(*) AS n FROM e GROUP BY ALL)"""
_K = f"""{_P}, k AS (SELECT chr, pos, max_by(base, (n, -instr('.ACGTN', base))) AS base, CAST(sum(n) AS BIGINT) AS depth FROM p GROUP BY chr, pos)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters(spark, sf_dir).where("seq <> ''").withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M")))


@query(f"WITH {_P} SELECT * FROM p")
def q_pileup(spark, sf_dir):
    return tiles.pileup_rows(tiles.tile_counts(_aligned(spark, sf_dir)))


@query(f"WITH {_P} SELECT * FROM p")
def q_pileup_rows(spark, sf_dir):
    """The same by a row a base, without Python."""
    return pileup.pileup(pileup.aligned_bases(pileup.with_spans(_aligned(spark, sf_dir))))


@query(f"WITH {_K} SELECT * FROM k")
def q_consensus(spark, sf_dir):
    return tiles.consensus_rows(tiles.tile_counts(_aligned(spark, sf_dir)))


@query(f"""WITH {_K}, {C}, x AS (SELECT k.chr, k.pos, CASE WHEN k.pos <= len(c.seq) THEN substr(c.seq, CAST(k.pos AS INTEGER), 1) ELSE 'N' END AS ref, k.base AS alt
FROM k JOIN c USING (chr)) SELECT * FROM x WHERE alt <> ref""")
def q_patches(spark, sf_dir):
    return _patches(spark, sf_dir)


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.patch_rows(tiles.tile_counts(_aligned(spark, sf_dir)), pileup.reference_chunks(contigs(spark, sf_dir)))


@query(f"""WITH {_K}, {C}, a AS (SELECT DISTINCT chr, doc_id * 7 % 3000 + 1 AS pos FROM l)
SELECT a.chr, a.pos, coalesce(k.base, CASE WHEN a.pos <= len(c.seq) THEN substr(c.seq, CAST(a.pos AS INTEGER), 1) END, 'N') AS base
FROM a LEFT JOIN k USING (chr, pos) LEFT JOIN c ON a.chr = c.chr""")
def q_patched_reference(spark, sf_dir):
    asks = letters(spark, sf_dir).select("chr", (F.col("doc_id") * 7 % 3000 + 1).alias("pos")).distinct()
    return pileup.patched_base(asks, _patches(spark, sf_dir), pileup.reference_chunks(contigs(spark, sf_dir)))


@query(f"""WITH {L}, {C} SELECT doc_id, CASE WHEN l.chr = '*' OR len(l.seq) = 0 THEN '' ELSE
rpad(substr(coalesce(c.seq, ''), CAST(pos AS INTEGER), len(l.seq)), CAST(len(l.seq) AS INTEGER), 'N') END AS ref FROM l LEFT JOIN c ON l.chr = c.chr""")
def q_reference_fetch(spark, sf_dir):
    df = letters(spark, sf_dir).withColumn("end_excl", F.col("pos") - 1 + F.length("seq"))
    return pileup.with_reference(df, pileup.reference_chunks(contigs(spark, sf_dir)), ["doc_id"]).select("doc_id", "ref")


_CIGAR = "concat(l_linenumber, 'S', CAST(l_quantity AS {int}), '{op}', l_linenumber % 3, 'I', l_orderkey % 4, 'D', l_linenumber, 'N3X2={clip}')"


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _CIGAR.format(int="int", op="M", clip="5H")
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as oid", "cast(l_linenumber as bigint) as ln", "cast(l_quantity as bigint) as q", f"{made} as cigar")


@query(f"""SELECT l_orderkey AS oid, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) + l_orderkey % 4 + l_linenumber + 5 AS ref_span,
l_linenumber + CAST(l_quantity AS BIGINT) + l_linenumber % 3 + 5 AS read_span,
concat(l_linenumber, 'S', CAST(l_quantity AS INTEGER), 'M', l_linenumber % 3, 'I', l_orderkey % 4, 'D', l_linenumber, 'N5M5H') AS normal FROM lineitem""")
def q_cigar_spans(spark, sf_dir):
    ops = alignment.parse_cigar(F.col("cigar"))
    return _cigars(spark, sf_dir).select(
        "oid", "ln", alignment.ref_span(ops).alias("ref_span"), alignment.read_span(ops).alias("read_span"), alignment.normalize_cigar(F.col("cigar")).alias("normal")
    )


@query(f"""WITH {L}, a AS (SELECT doc_id, seq, reverse(seq) AS ref FROM l WHERE len(seq) > 0)
SELECT doc_id, len(list_filter(range(1, len(seq) + 1), lambda i: substr(seq, CAST(i AS INTEGER), 1) <> substr(ref, CAST(i AS INTEGER), 1))) AS nm FROM a""")
def q_nm(spark, sf_dir):
    df = letters(spark, sf_dir).where("seq <> ''").withColumn("ops", alignment.parse_cigar(F.concat(F.length("seq").cast("string"), F.lit("M"))))
    return df.select("doc_id", alignment.nm_tag(F.col("ops"), F.col("seq"), F.reverse("seq")).alias("nm"))


_A = f"""{L}, {C}, a AS (SELECT l.doc_id, l.chr, len(list_filter(range(1, len(l.seq) + 1), lambda i:
  substr(l.seq, CAST(i AS INTEGER), 1) <> coalesce(nullif(substr(c.seq, CAST(l.pos - 1 + i AS INTEGER), 1), ''), 'N'))) AS nm
  FROM l JOIN c USING (chr) WHERE l.seq <> '')"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against the contig of their language, with an NM tag that is right but for every fifth."""
    df = letters(spark, sf_dir).where("seq <> '' and chr <> '*'").withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M")))
    df = derived.with_derived(df, pileup.reference_chunks(contigs(spark, sf_dir)), ["doc_id"])
    value = F.when(F.col("doc_id") % 5 == 0, F.lit("-1")).otherwise(F.col("derived")["NM"])
    own = F.array(F.lit("XA:Z:first"), F.concat(F.lit("NM:i:"), value), F.lit("XB:Z:last"))
    return df.withColumn("tags", fields.parse_tags(own))


@query(f"WITH {_A} SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'XA,NM,XB' ELSE 'XA,XB' END) AS stored, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE nm END AS nm, 'XA,NM,XB' AS again FROM a")
def q_derived_elision(spark, sf_dir):
    """Tags that alignment and reference give are left out of what is stored, and restored where they stood."""
    names = lambda: F.array_join(F.transform("tags", lambda t: t["tag"]), ",")
    df = _tagged(spark, sf_dir)
    made = F.col("derived")
    kept = derived.elide_derived(df.withColumn("made", made)).withColumn("stored", names()).withColumnRenamed("made", "derived")
    back = derived.restore_derived(kept)
    nm = F.filter("tags", lambda t: t["tag"] == "NM")[0]["value"].cast("long")
    return back.select("doc_id", "stored", nm.alias("nm"), names().alias("again"))


@query(f"WITH {_A} SELECT 'NM' AS tag, count(*) AS present, count(*) FILTER (doc_id % 5 = 0) AS mismatched FROM a HAVING count(*) > 0")
def q_mismatch_counts(spark, sf_dir):
    return derived.mismatch_counts(_tagged(spark, sf_dir))


@query(f"WITH {L}, {C} SELECT chr, len(seq) AS length, md5(seq) AS md5 FROM c")
def q_contig_digests(spark, sf_dir):
    return pileup.contig_digests(contigs(spark, sf_dir))


def _kinds(length: str, ref: int, read: int, other: str) -> str:
    """SQL of the aligned bases of an operation: `=` where they are equal."""
    return f"list_transform(range(0, {length}), lambda i: CASE WHEN f[i + {ref + 1}] = s[i + {read + 1}] THEN '=' ELSE {other.format(i=f'f[i + {ref + 1}]')} END)"


def _around(other: str, insertion: str, deletion: str) -> str:
    first, second, third = _kinds("3", 0, 0, other), _kinds("4", 3, 5, other), _kinds("len(s) - 9", 8, 9, other)
    return f"list_concat(list_concat(list_concat({first}, {insertion}), list_concat({second}, {deletion})), {third})"


_MD = f"""WITH {L}, a AS (SELECT doc_id, string_split(seq, '') AS s, list_reverse(string_split(seq, '')) AS f FROM l WHERE len(seq) > 12),
e AS (SELECT doc_id, {_around("{i}", "CAST([] AS VARCHAR[])", "['^' || f[8]]")} AS e, {_around("'X'", "['2I']", "['1D']")} AS g FROM a),
p AS (SELECT *, list_filter(range(len(e)), lambda i: e[i + 1] <> '=') AS spots,
  list_filter(range(len(g)), lambda i: i = 0 OR g[i + 1] <> g[i] OR len(g[i + 1]) > 1) AS runs FROM e),
d AS (SELECT *, list_transform(range(len(spots)), lambda k: spots[k + 1] - coalesce(spots[k], -1) - 1) AS gaps, len(e) - coalesce(spots[-1], -1) - 1 AS tail FROM p)
SELECT doc_id, array_to_string(list_transform(range(len(spots)), lambda k: concat(gaps[k + 1], e[spots[k + 1] + 1])), '') || tail AS md,
array_to_string(list_transform(range(len(spots)), lambda k: concat(CASE WHEN gaps[k + 1] > 0 THEN gaps[k + 1] END, e[spots[k + 1] + 1],
  CASE WHEN e[spots[k + 1] + 1][1] = '^' THEN '$' END)), '') || CASE WHEN tail > 0 THEN CAST(tail AS VARCHAR) ELSE '' END AS xd,
array_to_string(list_transform(range(len(runs)), lambda k: CASE WHEN len(g[runs[k + 1] + 1]) > 1 THEN g[runs[k + 1] + 1]
  ELSE concat(coalesce(runs[k + 2], len(g)) - runs[k + 1], g[runs[k + 1] + 1]) END), '') AS cigar FROM d"""


@query(_MD)
def q_md(spark, sf_dir):
    """MD, XD and the re-split CIGAR of texts against their reverse, with an insertion and a deletion."""
    n = F.length("seq")
    cigar = F.concat(F.lit("3M2I4M1D"), (n - 9).cast("string"), F.lit("M"))
    df = letters(spark, sf_dir).where("length(seq) > 12").withColumn("ops", alignment.parse_cigar(cigar)).withColumn("ref", F.reverse("seq"))
    md = alignment.md_tag(F.col("ops"), F.col("seq"), F.col("ref"))
    return df.select("doc_id", md.alias("md"), alignment.xd_from_md(md).alias("xd"), alignment.split_matches(F.col("ops"), F.col("seq"), F.col("ref")).alias("cigar"))


@query(f"WITH {L} SELECT doc_id, 2 * len(seq) AS n_bits, translate(seq, 'BDEFHIJKLMOPQRSUVWXYZ', repeat('N', 21)) AS again FROM l")
def q_two_bit_bases(spark, sf_dir):
    packed = alignment.pack_bases(F.col("seq"))
    df = letters(spark, sf_dir).withColumn("packed", packed)
    return df.select("doc_id", F.length("packed.bits").cast("long").alias("n_bits"), alignment.unpack_bases(F.col("packed")).alias("again"))


@query("SELECT l_orderkey AS oid, CAST(l_linenumber AS BIGINT) AS ln, 100 - l_linenumber - CAST(l_quantity AS BIGINT) - l_linenumber % 3 - 5 AS trailing FROM lineitem")
def q_trailing_match(spark, sf_dir):
    trailing = alignment.trailing_match(F.lit(100), alignment.parse_cigar(F.col("cigar")))
    return _cigars(spark, sf_dir).select("oid", "ln", trailing.alias("trailing"))


@query("""SELECT l_orderkey AS oid, CAST(l_linenumber AS BIGINT) AS ln, substr('MIDNSHP=X', CAST(l_partkey % 9 + 1 AS INTEGER), 1) AS op, CAST(l_quantity AS BIGINT) AS len,
substr('=ACMGRSVTWYHKDBN', CAST(l_partkey % 16 + 1 AS INTEGER), 1) AS base FROM lineitem""")
def q_bam_codes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as oid", "cast(l_linenumber as bigint) as ln", "cast(l_quantity as bigint) * 16 + l_partkey % 9 as word", "l_partkey % 16 as nibble")
    op = alignment.decode_bam_cigar(F.col("word"))
    return df.select("oid", "ln", op["op"].alias("op"), op["len"].alias("len"), alignment.decode_bam_base(F.col("nibble")).alias("base"))


# --- names

_SPLIT = r"[\x00-/:-@\[-`]"


@query(rf"""WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT -1 - page_id, url FROM pages)
SELECT id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens, len(list_filter(t, lambda x: regexp_full_match(x, '[1-9][0-9]*'))) AS n_numbers
FROM (SELECT id, string_split_regex(name, '{_SPLIT}') AS t FROM n)""")
def q_name_tokens(spark, sf_dir):
    tokens = fields.tokenize_name(F.col("name"))["tokens"]
    numbers = F.size(F.filter("t", fields.is_numeric_token))
    return _names(spark, sf_dir).select("id", tokens.alias("t")).select("id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", "|").alias("tokens"), numbers.cast("long").alias("n_numbers"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return people.unionByName(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("name")))


@query("SELECT c_custkey AS id, c_name AS again FROM customer UNION ALL SELECT -1 - page_id, url FROM pages")
def q_name_rebuild(spark, sf_dir):
    return _names(spark, sf_dir).select("id", fields.rebuild_name(fields.tokenize_name(F.col("name"))).alias("again"))


_T = rf"""t AS (SELECT c_nationkey AS part, c_custkey AS id, unnest(t) AS token, unnest(range(len(t))) AS slot
FROM (SELECT *, string_split_regex(concat(c_name, '.', c_mktsegment), '{_SPLIT}') AS t FROM customer))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit("."), "c_mktsegment")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("part"), F.col("c_custkey").alias("id"), fields.tokenize_name(name)["tokens"].alias("tokens"))


@query(f"""WITH {_T}, d AS (SELECT *, lag(token) OVER (PARTITION BY part, slot ORDER BY id) AS before FROM t)
SELECT part, id, slot, token FROM d WHERE token IS DISTINCT FROM before""")
def q_name_deltas(spark, sf_dir):
    return ordered.name_deltas(_tokens(spark, sf_dir), "tokens", ["part"], ["id"]).withColumn("slot", F.col("slot").cast("long"))


@query(f"WITH {_T} SELECT part, id, string_agg(token, '|' ORDER BY slot) AS tokens FROM t GROUP BY part, id")
def q_name_deltas_inverse(spark, sf_dir):
    df = _tokens(spark, sf_dir)
    changed = ordered.name_deltas(df, "tokens", ["part"], ["id"])
    back = ordered.name_deltas_inverse(df.select("part", "id", F.size("tokens").alias("n_tokens")), changed, ["part"], ["id"])
    return back.select("part", "id", F.array_join("tokens", "|").alias("tokens"))


@query("SELECT o_orderkey, concat('SRR', CASE WHEN o_orderkey > 0 THEN '|' END, o_orderkey, '|', o_custkey) AS tokens, concat('SRR', o_orderkey, '.', o_custkey) AS name, o_orderpriority AS comment FROM orders")
def q_accession_names(spark, sf_dir):
    line = F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string"), F.lit("."), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderpriority")
    parts = fields.name_and_comment(line)
    df = table(spark, sf_dir, "orders").select("o_orderkey", parts["name"].alias("name"), parts["comment"].alias("comment"))
    return df.withColumn("tokens", F.array_join(fields.tokenize_name(F.col("name"))["tokens"], "|"))


# --- qualities

_TRIM = "substr(qual, 1, CAST(least(len(qual), greatest(len(rtrim(qual, right(qual, 1))) + 1, 2)) AS INTEGER))"


@query(f"WITH {Q} SELECT doc_id, {_TRIM} AS trimmed FROM q WHERE qual <> ''")
def q_trim_run(spark, sf_dir):
    return qualities(spark, sf_dir).where("qual <> ''").select("doc_id", fields.trim_run(F.col("qual")).alias("trimmed"))


@query(f"WITH {Q} SELECT doc_id, qual AS again FROM q WHERE qual <> ''")
def q_pad_run(spark, sf_dir):
    again = fields.pad_run(fields.trim_run(F.col("qual")), F.length("qual"))
    return qualities(spark, sf_dir).where("qual <> ''").select("doc_id", again.alias("again"))


@query(f"WITH {Q} SELECT doc_id, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS forward FROM q")
def q_reverse_strand(spark, sf_dir):
    return qualities(spark, sf_dir).select("doc_id", fields.forward(F.col("qual"), F.col("flag")).alias("forward"))


_H = f"{Q}, h AS (SELECT ascii(ch) AS code, flag, count(*) AS n FROM (SELECT flag, unnest(string_split(qual, '')) AS ch FROM q WHERE qual <> '' AND qual <> '*') GROUP BY ALL)"


@query(f"WITH {_H} SELECT flag, code, n FROM h")
def q_quality_histogram(spark, sf_dir):
    return stats.quality_histogram(qualities(spark, sf_dir), "qual", ["flag"])


@query(f"WITH {_H} SELECT flag, CAST(CASE WHEN min(code) < 59 THEN 33 WHEN min(code) < 64 THEN 59 ELSE 64 END AS INTEGER) AS \"offset\" FROM h GROUP BY flag")
def q_quality_offset(spark, sf_dir):
    return stats.detect_offset(stats.quality_histogram(qualities(spark, sf_dir), "qual", ["flag"]), ["flag"])


@query(f"""WITH {Q} SELECT doc_id, CAST(coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 32)), 0) AS BIGINT) AS total, qual AS again FROM q WHERE qual <> ''""")
def q_quality_shift(spark, sf_dir):
    df = qualities(spark, sf_dir).where("qual <> ''").withColumn("v", fields.shift_quality(F.col("qual"), F.lit(33)))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda n, x: n + x)
    return df.select("doc_id", total.alias("total"), fields.unshift_quality(F.col("v"), F.lit(33)).alias("again"))


@query(f"""WITH {Q}, h AS (SELECT ascii(c) AS code, count(*) AS n FROM (SELECT unnest(string_split(qual, '')) AS c FROM q WHERE qual <> '' AND qual <> '*') GROUP BY ALL)
SELECT code, n, row_number() OVER (ORDER BY n DESC, code) - 1 AS rank FROM h""")
def q_codes_by_frequency(spark, sf_dir):
    return stats.by_frequency(stats.quality_histogram(qualities(spark, sf_dir), "qual"))


@query(f"WITH {_H} SELECT code, CAST(sum(n) AS BIGINT) AS n, round(pow(10.0, (33 - code) / 10.0), 9) AS error FROM h GROUP BY code")
def q_phred_errors(spark, sf_dir):
    counted = stats.quality_histogram(qualities(spark, sf_dir), "qual")
    return counted.select("code", "n", F.round(fields.phred_error(F.col("code"), 33), 9).alias("error"))


@query()
def q_lossy(spark, sf_dir):
    """Qualities after the lossy table, which is a walk over 128 codes that the tests repeat step by step."""
    return stats.quantise(qualities(spark, sf_dir), "qual", 30).select("doc_id", "qual")


_E = "SELECT lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS t FROM documents"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters(spark, sf_dir).select(F.lower("seq").alias("t"))


@query(f"SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(t, '')) AS symbol FROM ({_E}) WHERE t <> '') GROUP BY symbol")
def q_order0_model(spark, sf_dir):
    return columns.symbol_counts(_texts(spark, sf_dir), "t")


def _model(order: int) -> str:
    return f"""SELECT g[1:{order}] AS context, g[{order + 1}] AS symbol, count(*) AS n
FROM (SELECT substr(t, CAST(i AS INTEGER), {order + 1}) AS g FROM (SELECT t, unnest(range(1, len(t) - {order} + 1)) AS i FROM ({_E}))) GROUP BY ALL"""


@query(_model(1))
def q_order1_model(spark, sf_dir):
    return columns.context_counts(_texts(spark, sf_dir), "t", 1)


@query(_model(2))
def q_order2_model(spark, sf_dir):
    return columns.context_counts(_texts(spark, sf_dir), "t", 2)


@query(f"""WITH c AS (SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(t, '')) AS symbol FROM ({_E}) WHERE t <> '') GROUP BY symbol),
s AS (SELECT *, greatest(1, CAST(floor(n * 4096 / sum(n) OVER ()) AS BIGINT)) AS f, row_number() OVER (ORDER BY n DESC, symbol) AS k FROM c)
SELECT symbol, n, CAST(f + CASE WHEN k = 1 THEN 4096 - sum(f) OVER () ELSE 0 END AS BIGINT) AS freq FROM s""")
def q_scaled_frequencies(spark, sf_dir):
    return columns.scaled_frequencies(columns.symbol_counts(_texts(spark, sf_dir), "t"))


@query(f"""WITH {Q}, e AS (SELECT doc_id, unnest(range(len(qual))) AS i, least(ascii(unnest(string_split(qual, ''))) - 33, 62) + 1 AS q FROM q WHERE qual <> ''),
w AS (SELECT *, lag(q, 1, 0) OVER v AS a, lag(q, 2, 0) OVER v AS b, lag(q, 3, 0) OVER v AS c FROM e WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT *, sum(greatest(b - a, 0)) OVER (PARTITION BY doc_id ORDER BY i) + 5 AS d FROM w)
SELECT CAST(CASE WHEN i = 0 THEN 0 ELSE ((greatest(b, c) * 64 + a) & 4095) + CASE WHEN b = c THEN 4096 ELSE 0 END + least(7, d // 8) * 8192 + (least(i + 14, 127) & 120) * 8192 END AS INTEGER) AS context,
CAST(q AS INTEGER) AS q, count(*) AS n FROM d GROUP BY ALL""")
def q_quality_contexts(spark, sf_dir):
    """Counts of (context, code) of the position- and trend-dependent model; a fold over each string."""
    shifted = F.transform(fields.codes(F.col("qual")), lambda c: F.least(c - 33, F.lit(62)) + 1)
    df = qualities(spark, sf_dir).where("qual <> ''").withColumn("codes", shifted)
    return columns.quality_contexts(df, "doc_id", "codes").groupBy("context", "q").agg(F.count("*").alias("n"))


# --- tags, headers, integers


@query("""WITH v AS (SELECT 'PG' AS tag, p_brand AS value FROM part UNION ALL SELECT 'LB', p_type FROM part UNION ALL SELECT 'RG', o_orderpriority FROM orders)
SELECT tag, value, row_number() OVER (PARTITION BY tag ORDER BY value) - 1 AS id FROM (SELECT DISTINCT * FROM v)""")
def q_library_dictionary(spark, sf_dir):
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    rows = part.selectExpr("'PG' as tag", "p_brand as value").unionByName(part.selectExpr("'LB' as tag", "p_type as value"))
    return columns.sorted_dictionary(rows.unionByName(orders.selectExpr("'RG' as tag", "o_orderpriority as value")), ["tag"], "value")



@query("SELECT p_partkey, 'LB' AS tag, p_type AS value FROM part UNION ALL SELECT p_partkey, 'PG', p_brand FROM part")
def q_dictionary_decode(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.selectExpr("p_partkey", "'PG' as tag", "p_brand as value").unionByName(part.selectExpr("p_partkey", "'LB' as tag", "p_type as value"))
    dictionary = columns.sorted_dictionary(rows, ["tag"], "value")
    coded = rows.join(dictionary, ["tag", "value"]).select("p_partkey", "tag", "id")
    return columns.decode_dictionary(coded, dictionary, ["tag"], "value").select("p_partkey", "tag", "value")


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderkey * o_orderkey * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS v FROM orders)
SELECT id, CAST(CASE WHEN v BETWEEN -128 AND 127 THEN 1 WHEN v BETWEEN -32768 AND 32767 THEN 2 WHEN v BETWEEN -2147483648 AND 2147483647 THEN 4 ELSE 8 END AS INTEGER) AS signed,
CAST(CASE WHEN abs(v) < 255 THEN 1 WHEN abs(v) < 65536 THEN 2 ELSE 4 END AS INTEGER) AS varint,
CAST(CASE WHEN abs(v) < 256 THEN 1 WHEN abs(v) < 65536 THEN 2 WHEN abs(v) < 16777216 THEN 3 WHEN abs(v) < 4294967296 THEN 4 ELSE 8 END AS INTEGER) AS sized FROM v""")
def q_integer_classes(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderkey * o_orderkey * if(o_orderkey % 2 = 0, 1, -1) as v")
    size = F.abs("v")
    return v.select("id", fields.width_class(F.col("v")).alias("signed"), fields.varint_class(size).alias("varint"), fields.sized_class(size).alias("sized"))


@query("SELECT event_id, 'XP' AS tag, 'Z' AS type, props AS value FROM events WHERE props IS NOT NULL")
def q_tag_parse(spark, sf_dir):
    parsed = fields.parse_tag(F.concat(F.lit("XP:Z:"), "props"))
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", parsed["tag"].alias("tag"), parsed["type"].alias("type"), parsed["value"].alias("value"))


@query("SELECT event_id, concat('Z:', event_type) AS xt, concat('i:', user_id) AS xu, CAST(2 AS INTEGER) AS n FROM events")
def q_tag_map(spark, sf_dir):
    texts = F.array(F.lit("XT:Z:first"), F.concat(F.lit("XU:i:"), F.col("user_id").cast("string")), F.concat(F.lit("XT:Z:"), "event_type"))
    df = table(spark, sf_dir, "events").withColumn("m", fields.tag_map(fields.parse_tags(texts)))
    return df.select("event_id", F.col("m")["XT"].alias("xt"), F.col("m")["XU"].alias("xu"), F.size("m").alias("n"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS stored, event_type AS again FROM events")
def q_tag_elision(spark, sf_dir):
    stored = fields.elide(F.col("event_type"), F.lit("click"))
    return table(spark, sf_dir, "events").select("event_id", stored.alias("stored"), fields.restore(stored, F.lit("click")).alias("again"))


@query("""SELECT p_partkey, ((ascii(substr(p_brand, 1, 1)) - 33) * 94 + ascii(substr(p_brand, 2, 1)) - 33) * 94 + ascii(substr(p_type, 1, 1)) - 33 AS key,
substr(p_brand, 1, 2) AS tag, substr(p_type, 1, 1) AS type FROM part""")
def q_tag_key(spark, sf_dir):
    key = fields.tag_key(F.substring("p_brand", 1, 2), F.substring("p_type", 1, 1))
    df = table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
    return df.select("p_partkey", "key", fields.tag_of_key(F.col("key"))["tag"].alias("tag"), fields.tag_of_key(F.col("key"))["type"].alias("type"))


@query("SELECT n_nationkey, 'SQ' AS record_type, n_name AS sn, CAST(n_regionkey AS VARCHAR) AS ln, CAST(2 AS INTEGER) AS n FROM nation")
def q_header_attrs(spark, sf_dir):
    line = F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), F.col("n_regionkey").cast("string"))
    df = table(spark, sf_dir, "nation").withColumn("h", fields.header_attributes(line))
    return df.select("n_nationkey", "h.record_type", F.col("h.attrs")["SN"].alias("sn"), F.col("h.attrs")["LN"].alias("ln"), F.size("h.attrs").alias("n"))


@query("""SELECT p_partkey, tag, tag IN ('BQ', 'CQ', 'E2', 'OQ', 'QT', 'Q2', 'U2') AS quality
FROM (SELECT p_partkey, ['BQ', 'RG', 'CQ', 'E2', 'NM', 'OQ', 'QT', 'Q2', 'MD', 'U2'][p_partkey % 10 + 1] AS tag FROM part)""")
def q_quality_tags(spark, sf_dir):
    tags = F.array(*map(F.lit, ("BQ", "RG", "CQ", "E2", "NM", "OQ", "QT", "Q2", "MD", "U2")))
    df = table(spark, sf_dir, "part").select("p_partkey", F.get(tags, (F.col("p_partkey") % 10).cast("int")).alias("tag"))
    return df.withColumn("quality", fields.is_quality_tag(F.col("tag")))


# --- bags, lines


def _two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("file_id", F.lit(0)).unionByName(reads(spark, sf_dir).where("flag >= 16").withColumn("file_id", F.lit(1)))


@query(f"WITH {R} SELECT 0 AS file_id, flag, count(*) AS n FROM r GROUP BY flag UNION ALL SELECT 1, flag, count(*) FROM r WHERE flag >= 16 GROUP BY flag")
def q_bag_union(spark, sf_dir):
    return stats.flag_histogram(_two_files(spark, sf_dir), ["file_id"])


@query(f"""WITH {M} SELECT CAST(oid % 2 AS INTEGER) AS file_id, row_number() OVER (PARTITION BY oid % 2 ORDER BY oid, row) - 1 + (SELECT count(*) FROM nation) AS line_no,
rname, flag, chr, pos, CAST(oid AS VARCHAR) AS xo FROM m""")
def q_split_files(spark, sf_dir):
    """Mixed reads of two files, written by the sink with a commit as the files they came from, header first, and read back."""
    path = shared_path(spark, "split")
    sinks.write_files(_lines(spark, sf_dir).repartition(8), path, _header(spark, sf_dir), names={0: "even.sam", 1: "odd.sam"}, single=True)
    back = text.read_sam(spark, [f"{path}/even.sam", f"{path}/odd.sam"])
    return back.select("file_id", F.col("row_id").alias("line_no"), "rname", "flag", "chr", "pos", F.col("tags")[0]["value"].alias("xo"))


@query(f"""WITH {M} SELECT oid, row, concat_ws(chr(9), rname, CAST(flag AS VARCHAR), m.chr, CAST(pos AS VARCHAR), '255', concat(span, 'M'), pchr, CAST(ploc AS VARCHAR),
CAST(tlen AS VARCHAR), '*', '*', concat('XO:i:', oid)) AS line FROM m""")
def q_sam_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("oid", "row", text.sam_line().alias("line"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mated reads with all fields of a line, in two files."""
    tags = fields.parse_tags(F.array(F.concat(F.lit("XO:i:"), F.col("oid").cast("string"))))
    return mated(spark, sf_dir).withColumns(
        {
            "mapq": F.lit(255), "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "seq": F.lit("*"), "qual": F.lit("*"), "tags": tags,
            "file_id": (F.col("oid") % 2).cast("int"), "row_id": F.col("oid") * 100 + F.col("row"),
        }
    )


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig line for each nation, in both files."""
    raw = F.concat(F.lit("@SQ\tSN:chr"), F.col("n_nationkey").cast("string"), F.lit("\tLN:"), (F.col("n_regionkey") + 1000).cast("string"), F.lit("\tDS:"), "n_name")
    df = table(spark, sf_dir, "nation").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("file_id"), F.col("n_nationkey").cast("long").alias("line_no"), raw.alias("raw"))
    return df.select("file_id", "line_no", fields.header_attributes(F.col("raw"))["record_type"].alias("record_type"), fields.header_attributes(F.col("raw"))["attrs"].alias("attrs"), "raw")


def _sam_files(spark: SparkSession, sf_dir: str) -> list[str]:
    path = shared_path(spark, "sam")
    text.write_sam(_lines(spark, sf_dir), path, _header(spark, sf_dir))
    return [f"{path}/file_id={i}" for i in range(2)]


@query(f"""WITH {M} SELECT CAST(oid % 2 AS INTEGER) AS file_id, row_number() OVER (PARTITION BY oid % 2 ORDER BY oid, row) - 1 + (SELECT count(*) FROM nation) AS line_no,
rname, flag, chr, pos, concat(span, 'M') AS cigar, pchr, ploc, CAST(tlen AS INTEGER) AS tlen, CAST(oid AS VARCHAR) AS xo FROM m""")
def q_sam_files(spark, sf_dir):
    """Reads written as text, two files with headers, and read back."""
    back = text.read_sam(spark, _sam_files(spark, sf_dir))
    return back.select("file_id", F.col("row_id").alias("line_no"), "rname", "flag", "chr", "pos", "cigar", "pchr", "ploc", "tlen", F.col("tags")[0]["value"].alias("xo"))


@query("""SELECT CAST(f AS INTEGER) AS file_id, CAST(n_nationkey AS BIGINT) AS line_no, concat('chr', n_nationkey) AS name, CAST(n_regionkey + 1000 AS VARCHAR) AS ln, n_name AS ds
FROM nation, (VALUES (0), (1)) v(f)""")
def q_sam_headers(spark, sf_dir):
    """Contig lines of written files, looked up by name."""
    header = text.read_header(spark, _sam_files(spark, sf_dir))
    named = text.header_registry(header, "SQ").join(header.select("file_id", "line_no", F.col("attrs")["SN"].alias("name")), ["file_id", "name"])
    return named.select("file_id", "line_no", "name", F.col("attrs")["LN"].alias("ln"), F.col("attrs")["DS"].alias("ds"))


_BAM = "CAST(oid % 2 AS INTEGER) AS file_id, rname, flag, chr, pos, concat(span, 'M') AS cigar, pchr, ploc, CAST(tlen AS INTEGER) AS tlen, CAST(oid AS VARCHAR) AS xo"
BAM = ["file_id", "rname", "flag", "chr", "pos", "cigar", "pchr", "ploc", "tlen", "tags[0].value as xo"]


def _bam_files(spark: SparkSession, sf_dir: str) -> list[str]:
    path = shared_path(spark, "bam")
    sinks.write_files(_lines(spark, sf_dir), path, _header(spark, sf_dir), "bam", order=["chr", "pos", "row_id"], single=True)
    return [f"{path}/{i}.bam" for i in range(2)]


@query(f"WITH {M} SELECT {_BAM} FROM m")
def q_bam_files(spark, sf_dir):
    """Reads written as two files of compressed blocks and read back, a task for each stretch of 64 KiB."""
    return bam.read_bam(spark, _bam_files(spark, sf_dir), 1 << 16).selectExpr(*BAM)


@query(f"WITH {M} SELECT {_BAM.replace("CAST(oid % 2 AS INTEGER)", "0")} FROM m WHERE oid % 2 = 1 AND chr = 'chr2' AND pos <= 900 AND (pos >= 500 OR pos - 1 + span >= 500)")
def q_bam_range(spark, sf_dir):
    """Reads of a range of an indexed file, from the blocks that can hold them."""
    path = _bam_files(spark, sf_dir)[1]
    bam.index_bam(spark, path, 1 << 16)
    return bam.read_bam_range(spark, path, ranges.Range("chr2", 500, 900), overlap=True, split_bytes=1 << 16).selectExpr(*BAM)


@query("SELECT CAST(f AS INTEGER) AS file_id, CAST(n_nationkey AS INTEGER) AS chr_no, concat('chr', n_nationkey) AS chr, CAST(n_regionkey + 1000 AS BIGINT) AS length FROM nation, (VALUES (0), (1)) v(f)")
def q_bam_contigs(spark, sf_dir):
    """Contig dictionaries of written files."""
    return bam.read_bam_header(spark, _bam_files(spark, sf_dir))[1]


def _store(spark: SparkSession, sf_dir: str) -> ReadStore:
    path = shared_path(spark, "store")
    store.write_store(_lines(spark, sf_dir).drop("oid", "row", "span"), path, _header(spark, sf_dir), block_rows=1000)
    return ReadStore(spark, path)


@query(f"WITH {M} SELECT CAST(oid % 2 AS INTEGER) AS file_id, oid * 100 + row AS row_id, rname, flag, chr, pos, pchr, ploc, tlen, span AS ref_span, pos - 1 + span AS end_excl FROM m")
def q_store_scan(spark, sf_dir):
    return _store(spark, sf_dir).query().select("file_id", "row_id", "rname", "flag", "chr", "pos", "pchr", "ploc", "tlen", "ref_span", "end_excl")


@query(f"""WITH {M}, g(range_no, f, c, s, e) AS (VALUES (0, 0, 'chr2', 500, 900), (1, 1, 'chr1', 100, 300))
SELECT range_no, oid * 100 + row AS row_id, pos, '@' AS qual FROM m JOIN g ON chr = c AND oid % 2 = f AND pos <= e AND (pos >= s OR pos - 1 + span >= s) WHERE flag & 1 = 1 AND flag & 32 <> 32""")
def q_store_query(spark, sf_dir):
    """Two ranges of two files of a store, by overlap and flags, without qualities."""
    found = _store(spark, sf_dir).query("chr2:500-900;1,chr1:100-300", flag=1, exclude=32, overlap=True, no_quality=True)
    return found.select("range_no", "row_id", "pos", "qual")


@query(f"WITH {M} SELECT CAST(oid % 2 AS INTEGER) AS file_id, flag, count(*) AS n FROM m GROUP BY ALL")
def q_store_flags(spark, sf_dir):
    return _store(spark, sf_dir).flags()


@query(f"WITH {M} SELECT CAST(oid % 2 AS INTEGER) AS file_id, m.chr, count(*) AS reads, CAST(any_value(n_regionkey) + 1000 AS BIGINT) AS length FROM m JOIN nation ON m.chr = concat('chr', n_nationkey) GROUP BY ALL")
def q_store_contigs(spark, sf_dir):
    return store.contig_listing(spark, _store(spark, sf_dir).path)


@query(f"WITH {L}, {C} SELECT chr, len(seq) AS length, md5(seq) AS md5 FROM c WHERE seq <> ''")
def q_fasta_files(spark, sf_dir):
    """Contigs written as FASTA in lines of 60, read back in chunks by ranges of bytes."""
    path = shared_path(spark, "fasta")
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    contigs(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit(">"), "chr", F.lit(" made of text\n"), F.lower(wrapped)).alias("value")).write.text(path)
    return fasta.chunk_digests(fasta.fasta_chunks(spark, path, split_bytes=1000))


@query("SELECT concat('O', o_orderkey) AS name, o_orderpriority AS comment FROM orders")
def q_fastq_files(spark, sf_dir):
    """Orders written as FASTQ records, their names read back."""
    path = shared_path(spark, "fastq")
    record = F.concat(F.lit("@O"), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit("\nACGT\n+\n@@II"))
    table(spark, sf_dir, "orders").select(record.alias("value")).write.text(path)
    return text.read_fastq_names(spark, path).select("name", "comment")


# --- streams


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Rows of a stream over what is there now, in complete mode: written as Parquet to the shared folder and read back."""
    path = shared_path(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")  # a batch has all rows so far

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT CAST(length(event_type) AS INTEGER) AS flag, count(*) AS n FROM events GROUP BY ALL")
def q_stream_flag_counts(spark, sf_dir):
    return _drained(streams.flag_counts(_events(spark, sf_dir).select(F.length("event_type").alias("flag"))), "flag-counts")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    return _drained(streams.windowed_counts(_events(spark, sf_dir), "ts", window="1 day", by=["event_type"]), "windows")


def _appended(stream: DataFrame, name: str) -> DataFrame:
    """Rows that a stream over what is there now appends, batch by batch, to the shared folder."""
    path = shared_path(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query("""SELECT concat('U', a.user_id) AS rname, a.event_id AS first_row, b.event_id AS second_row FROM events a JOIN events b
ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE""")
def q_stream_mates(spark, sf_dir):
    """Events of one user as open mates."""
    shaped = _events(spark, sf_dir).selectExpr("concat('U', user_id) as rname", "event_id as row", "0L as pos", "0L as ploc", "0L as tlen", "cast(ts as timestamp) as t")
    return _appended(streams.open_mates(shaped, "t"), "open-mates")


@query("SELECT event_type AS chr, event_id AS pos FROM events")
def q_stream_store(spark, sf_dir):
    """Events as micro-batches into a store."""
    path = shared_path(spark, "appended")
    q = streams.append_to_store(_events(spark, sf_dir).selectExpr("event_type as chr", "event_id as pos"), f"{path}/rows", f"{path}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{path}/rows").select("chr", "pos")


@query("""WITH p AS (SELECT CAST(date_diff('day', TIMESTAMP '1900-01-01', l_shipdate) AS BIGINT) AS place, l_returnflag AS base FROM lineitem)
SELECT place, base, count(*) AS n FROM p WHERE place <= (SELECT max(place) FROM p) - 50 GROUP BY ALL""")
def q_stream_settled(spark, sf_dir):
    """Counts at ship dates, as bases, that lie 50 days behind the last one."""
    schema = table(spark, sf_dir, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    shaped = lines.selectExpr("cast(datediff(l_shipdate, timestamp '1900-01-01') as bigint) as place", "l_returnflag as base")
    return _appended(streams.settled_bases(shaped, "place", 50), "settled")


def _over_batches(df: DataFrame, number: str, n: int, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream appends whose rows come in n micro-batches, by a column that tells which: the stream is stopped and started again in between."""
    path = shared_path(df.sparkSession, name)
    for i in range(n):
        df.where(F.col(number) == i).write.mode("append").parquet(f"{path}/in")
        stream = make(df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query(ORACLE_SQL["q_mate_pairs"])
def q_stream_pending_mates(spark, sf_dir):
    """The mate fold over a stream whose names come in three micro-batches."""
    df = mated(spark, sf_dir).withColumns({"t": F.timestamp_seconds(F.col("row") * 60 + 86_400), "batch": F.least(F.floor((F.col("row") - 1) / 2), F.lit(2))})
    df = materialize(df, "mated")
    pairs = _over_batches(df, "batch", 3, lambda stream: stateful.pending_mates(stream, ["oid"], "t", "10 days"), "pending-mates")
    return mates.both_sides(pairs, ["oid"])


@query(f"SELECT * FROM ({ORACLE_SQL['q_patches']}) WHERE chr < (SELECT max(lang) FROM documents)")
def q_stream_patches(spark, sf_dir):
    """Patches of a stream of reads in coordinate order, in four micro-batches, as their tiles settle: all contigs but the last."""
    names = sorted(r["chr"] for r in contigs(spark, sf_dir).select("chr").collect())
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("chr")) - 1
    placed = _aligned(spark, sf_dir).where("chr <> '*'").withColumn("place", rank * 10_000_000 + F.col("pos"))
    bounds = placed.agg(F.percentile_approx("place", [0.25, 0.5, 0.75]).alias("p")).first()["p"]
    number = sum(((F.col("place") > b).cast("int") for b in bounds), F.lit(0))
    settled = _over_batches(placed.withColumn("batch", number), "batch", 4, lambda stream: stateful.settled_tiles(stream, "place"), "settled-tiles")
    return tiles.patch_rows(settled, pileup.reference_chunks(contigs(spark, sf_dir))).where(F.col("chr") < names[-1])


@query(f"""WITH {M} SELECT concat(CAST(oid % 2 AS INTEGER), '.sam') AS file, rname, flag, chr, pos, pchr, ploc, CAST(tlen AS INTEGER) AS tlen, CAST(oid AS VARCHAR) AS xo FROM m""")
def q_stream_sam_files(spark, sf_dir):
    """A stream of the lines of written files, by ranges of their bytes."""
    path = shared_path(spark, "tailed")
    sinks.write_files(_lines(spark, sf_dir), path, _header(spark, sf_dir), single=True)
    stream = tail.tail_sam(spark, path, split_bytes=1 << 18).selectExpr("substring_index(path, '/', -1) as file", "rname", "flag", "chr", "pos", "pchr", "ploc", "tlen", "tags[0].value as xo")
    out = shared_path(spark, "tailed-rows")
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(ORACLE_SQL["q_reference_fetch"])
def q_reference_fetch_bucketed(spark, sf_dir):
    """The same from tables in buckets of the same places; long texts take the other way."""
    df = letters(spark, sf_dir).withColumn("end_excl", F.col("pos") - 1 + F.length("seq"))
    chunks = pileup.reference_chunks(contigs(spark, sf_dir))
    name = f"readloom_{uuid.uuid4().hex}"
    bases, rows = buckets.save_reference(chunks, f"{name}_bases", 8), buckets.save_reads(df, f"{name}_reads", 8)
    return buckets.with_bucketed_reference(rows, bases, ["doc_id"], chunks).select("doc_id", "ref")


@query(ORACLE_SQL["q_patched_reference"])
def q_patched_reference_chunks(spark, sf_dir):
    """The same from chunks with their patches in place; a place beyond them keeps its patch."""
    asks = letters(spark, sf_dir).select("chr", (F.col("doc_id") * 7 % 3000 + 1).alias("pos")).distinct()
    patches, chunks = _patches(spark, sf_dir), pileup.reference_chunks(contigs(spark, sf_dir))
    based = pileup.reference_base(asks, buckets.patched_chunks(chunks, patches)).withColumnRenamed("ref", "base")
    beyond = patches.where("ref = 'N'").select("chr", "pos", "alt")
    return based.join(beyond, ["chr", "pos"], "left").select("chr", "pos", F.coalesce("alt", "base").alias("base"))


@query("SELECT event_id, printf('%g', value * power(10, event_id % 17 - 8)) AS shown FROM events")
def q_float_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fields.float_text(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 17 - 8)).alias("shown"))


@query(f"""WITH {_T}, k AS (SELECT * FROM t WHERE id % 3 <> 0), d AS (SELECT *, lag(token) OVER (PARTITION BY part, slot ORDER BY id) AS before FROM k)
SELECT part, id, slot, token FROM d WHERE token IS DISTINCT FROM before""")
def q_name_deltas_skipped(spark, sf_dir):
    """Names of every third row are told by a mate: they are left out, and not looked back at."""
    out = ordered.name_deltas(_tokens(spark, sf_dir), "tokens", ["part"], ["id"], F.col("id") % 3 == 0)
    return out.withColumn("slot", F.col("slot").cast("long"))


@query("SELECT c_custkey, upper(regexp_replace(c_mktsegment || c_name, '[^A-Za-z]', '', 'g')) AS seq FROM customer")
def q_sequence_rebuild(spark, sf_dir):
    """Reads against their reverse as reference: operations are split where bases differ, the bases that differ stored, and reads made again."""
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "upper(regexp_replace(c_mktsegment || c_name, '[^A-Za-z]', '')) as seq")
    df = df.withColumn("ops", alignment.parse_cigar(F.concat(F.length("seq").cast("string"), F.lit("M"))))
    cut = df.withColumn("cut", alignment.parse_cigar(alignment.split_matches(F.col("ops"), F.col("seq"), F.reverse("seq"))))
    return cut.select("c_custkey", alignment.rebuild_sequence(F.col("cut"), alignment.stored_bases(F.col("cut"), F.col("seq")), F.reverse("seq")).alias("seq"))


@query(f"""WITH {M}, k AS (SELECT chr, 'XO:i' AS key, (oid * 100 + row) * 4 AS place FROM m
UNION ALL SELECT chr, 'XA:A', (oid * 100 + row) * 4 + 1 FROM m WHERE row % 2 = 0 UNION ALL SELECT chr, 'XF:f', (oid * 100 + row) * 4 + 2 FROM m WHERE row % 3 = 0)
SELECT chr, key, row_number() OVER (PARTITION BY chr ORDER BY min(place)) - 1 AS id FROM k GROUP BY chr, key""")
def q_tag_keys(spark, sf_dir):
    """Tags of reads with one to three, numbered by where a contig first has them."""
    more = [F.when(F.col("row") % 2 == 0, "XA:A:!"), F.when(F.col("row") % 3 == 0, "XF:f:0.5")]
    named = F.array_compact(F.array(F.concat(F.lit("XO:i:"), F.col("oid").cast("string")), *more))
    df = mated(spark, sf_dir).select("chr", (F.col("oid") * 100 + F.col("row")).alias("at"), fields.parse_tags(named).alias("tags"))
    return columns.tag_keys(df, ["chr"], "at")
