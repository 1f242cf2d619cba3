"""Flag statistics, quality histograms and the lossy quality table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.fields import quality_offset
from readloom.operators.columns import BLOCK_ROWS


def flag_histogram(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., flag, n)."""
    return reads.groupBy(*(by or []), "flag").agg(F.count("*").alias("n"))


def filtered_count(histogram: DataFrame, mask: int) -> DataFrame:
    """(included, excluded): reads with all bits of a mask, and with none, from a flag histogram."""
    bits = F.col("flag").bitwiseAND(mask)
    count = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias
    return histogram.agg(count(bits == mask)("included"), count(bits == 0)("excluded"))


def stats_report(reads: DataFrame) -> DataFrame:
    """(flag, reads, mapped, unmapped, contigs): one row for each flag and one, with flag null, for all."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    contig = F.when(F.col("chr") != "*", F.col("chr"))
    grouped = reads.select("flag", mapped.alias("m"), contig.alias("c")).rollup("flag")
    return grouped.agg(F.count("*").alias("reads"), F.count_if("m").alias("mapped"), F.count_if(~F.col("m")).alias("unmapped"), F.countDistinct("c").alias("contigs"))


def quality_histogram(df: DataFrame, qual: str, by: list[str] | None = None) -> DataFrame:
    """(by..., code, n) of the characters of a quality column; `*` has none."""
    each = df.where((F.length(qual) > 0) & (F.col(qual) != "*")).select(*(by or []), F.explode(F.split(qual, "")).alias("ch"))
    return each.groupBy(*(by or []), F.ascii("ch").alias("code")).agg(F.count("*").alias("n"))


def by_frequency(histogram: DataFrame, symbol: str = "code") -> DataFrame:
    """Adds rank: symbols from the most frequent on, ties by symbol. An alphabet is small, so one window over it is too."""
    return histogram.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), symbol)) - 1).cast("long"))


def detect_offset(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., offset) from a quality histogram."""
    return histogram.groupBy(*(by or [])).agg(quality_offset(F.min("code")).alias("offset"))


def lossy_table(counts: dict[int, int], offset: int, percent: float) -> dict[int, int]:
    """Replacement of each quality code so that errors stay near what they were.

    Codes that state an error above 30 % become `offset`. Then the codes that are no rarer than both neighbours, the most
    frequent first (ties: the smaller), each take the codes to both sides that are not taken yet, as long as the mean
    error from the peak to there stays within `percent` of the peak's own. `counts` has at most 128 codes.
    """
    table = {c: c for c in range(128)}
    if not percent:
        return table
    error = [10 ** ((offset - c) / 10) for c in range(128)]
    taken = {c for c in range(offset, 128) if error[c] > 0.3}
    table.update(dict.fromkeys(taken, offset))

    def reach(peak: int, step: int, limit: float) -> int:
        """Last code that joins the peak in a direction; the peak itself if no code ends the walk."""
        total, c = error[peak], peak + step
        while 0 <= c < 128:
            total += error[c]
            mean = total / (abs(c - peak) + 1)
            if c in taken or (mean > limit if step < 0 else mean < limit):
                return c - step
            c += step
        return peak

    for peak in sorted((c for c in counts if counts[c] > 0), key=lambda c: (-counts[c], c)):
        if peak in taken or counts[peak] < max(counts.get(peak - 1, 0), counts.get(peak + 1, 0)):
            continue
        low = reach(peak, -1, error[peak] * (1 + percent / 100))
        high = reach(peak, 1, error[peak] * (1 - percent / 100))
        for c in range(low, high + 1):
            table[c] = peak
            taken.add(c)
    return table


def apply_lossy(qual: Column, table: dict[int, int]) -> Column:
    """Qualities with their codes replaced."""
    changed = {k: v for k, v in table.items() if k != v}
    return F.translate(qual, "".join(map(chr, changed)), "".join(map(chr, changed.values()))) if changed else qual


def first_block(df: DataFrame, rows: int) -> DataFrame:
    """The first `rows` rows of each file, by row_id."""
    from readloom.operators import ordered

    return ordered.row_numbers(df, ["file_id"], ["row_id"], "_row").where(F.col("_row") < rows).drop("_row")


def quantise(df: DataFrame, qual: str, percent: float, scope: str = "all", rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with lossy qualities, by one table for each file if there is a file_id. A table comes from all of a file's rows, or with the scope
    `first_block` from its first `rows`. Histograms that reach the driver have at most 128 rows a file."""
    if scope not in ("all", "first_block"):
        raise ValueError(f"no scope {scope!r}")
    by = ["file_id"] if "file_id" in df.columns else []
    seen = first_block(df.select(*by, "row_id", qual), rows) if scope == "first_block" else df
    counts: dict[int, dict[int, int]] = {}
    for r in quality_histogram(seen, qual, by).where("code < 128").collect():
        counts.setdefault(r["file_id"] if by else 0, {})[r["code"]] = r["n"]
    out = F.col(qual)
    for file_id, own in counts.items():
        least = min(own)
        offset = 33 if least < 59 else 59 if least < 64 else 64
        changed = apply_lossy(F.col(qual), lossy_table(own, offset, percent))
        out = F.when(F.col("file_id") == file_id, changed).otherwise(out) if by else changed
    return df.withColumn(qual, out)


def column_sizes(path: str, spark) -> DataFrame:
    """(column, bytes) that a Parquet store takes for each column, from its footers."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).distinct()

    def sizes(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                meta = pq.ParquetFile(store.open_input_file(at)).metadata
                found = [(meta.row_group(g).column(c).path_in_schema.split(".")[0], meta.row_group(g).column(c).total_compressed_size) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
                yield pa.record_batch({"column": pa.array([x for x, _ in found], pa.string()), "n": pa.array([x for _, x in found], pa.int64())})

    return files.mapInArrow(sizes, "column string, n long").groupBy("column").agg(F.sum("n").alias("bytes"))
