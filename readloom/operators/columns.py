"""Column transforms of ordered rows and their inverses: deltas, runs, blocks, dictionaries, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Deltas from here on are escaped.
ESCAPE = 254
BLOCK_ROWS = 1_000_000


def assert_sorted(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """`df`; reading a row that is out of order is an error."""
    w = Window.partitionBy(*partition).orderBy(*order)
    late = F.col(value) < F.lag(value).over(w)
    return df.withColumn(value, F.when(late, F.raise_error(F.lit(f"rows are not sorted by {value}"))).otherwise(F.col(value)))


def assign_blocks(df: DataFrame, partition: list[str], order: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds block_id: rows of a partition, in order, `rows` to a block. A partition is one task's; ordered.assign_blocks is for
    whole contigs."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("block_id", F.floor((F.row_number().over(w) - 1) / rows).cast("long"))


def block_index(df: DataFrame, partition: list[str]) -> DataFrame:
    """One row a block: rows, first and last start, largest end."""
    return df.groupBy(*partition, "block_id").agg(
        F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max("end_excl").alias("last_end")
    )


def sorted_dictionary(df: DataFrame, partition: list[str], value: str) -> DataFrame:
    """(partition..., value, id): distinct values numbered in sorted order. The window sees distinct values only."""
    distinct = df.select(*partition, value).where(F.col(value).isNotNull()).distinct()
    return distinct.withColumn("id", (F.row_number().over(Window.partitionBy(*partition).orderBy(value)) - 1).cast("long"))


def decode_dictionary(coded: DataFrame, dictionary: DataFrame, partition: list[str], value: str) -> DataFrame:
    """Inverse of the dictionaries: adds `value` to rows (partition..., id)."""
    return coded.join(dictionary.select(*partition, "id", value), [*partition, "id"], "left")


def first_seen_dictionary(df: DataFrame, partition: list[str], value: str, order: str) -> DataFrame:
    """(partition..., value, id): distinct values numbered by their first row."""
    first = df.groupBy(*partition, value).agg(F.min(order).alias("first"))
    return first.withColumn("id", (F.row_number().over(Window.partitionBy(*partition).orderBy("first")) - 1).cast("long")).drop("first")


def tag_keys(reads: DataFrame, partition: list[str], order: str) -> DataFrame:
    """(partition..., key, id): tags with their types, `NM:i`, numbered by the first read that has them and their place in it."""
    each = reads.select(*partition, F.col(order).alias("_at"), F.explode("tags").alias("t"))
    keyed = each.select(*partition, F.concat_ws(":", "t.tag", "t.type").alias("key"), F.struct("_at", "t.pos").alias("_at"))
    return first_seen_dictionary(keyed, partition, "key", "_at")


def coordinate_order(df: DataFrame, rank: DataFrame) -> DataFrame:
    """Rows in the order of (contig rank, pos, row_id), `*` last. `rank` is (chr, id), one row a contig."""
    ranked = df.join(rank.select("chr", F.col("id").alias("chr_rank")), "chr", "left")
    return ranked.orderBy(F.col("chr") == "*", F.col("chr_rank").asc_nulls_last(), "pos", "row_id")


def symbol_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """(by..., symbol, n): order-0 counts of the characters of a column."""
    return df.where(F.length(text) > 0).select(*(by or []), F.explode(F.split(text, "")).alias("symbol")).groupBy(*(by or []), "symbol").agg(F.count("*").alias("n"))


def context_counts(df: DataFrame, text: str, order: int) -> DataFrame:
    """(context, symbol, n): counts of a character after the `order` ones before it in the same text."""
    grams = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return counted.select(F.substring("gram", 1, order).alias("context"), F.substring("gram", order + 1, 1).alias("symbol"), "n")


def scaled_frequencies(counts: DataFrame, total: int = 4096) -> DataFrame:
    """Adds freq: counts scaled to a sum of `total`, at least 1 each; what rounding leaves goes to the most frequent symbol.
    An alphabet is small, so one window over it is too."""
    w = Window.partitionBy()
    scaled = counts.withColumn("freq", F.greatest(F.lit(1), F.floor(F.col("n") * total / F.sum("n").over(w))).cast("long"))
    top = F.row_number().over(Window.orderBy(F.desc("n"), "symbol"))
    return scaled.withColumn("freq", F.col("freq") + F.when(top == 1, F.lit(total) - F.sum("freq").over(w)).otherwise(F.lit(0)))


def quality_contexts(df: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, i, context, q): for each code of an array of quality codes the context that the earlier ones give: the larger
    of the second and third last beside the last (6 bits), whether those two are equal, the summed drops and the position,
    each in steps. The first code of an array has context 0."""
    each = df.select(key, F.posexplode(codes).alias("i", "q"))
    w = Window.partitionBy(key).orderBy("i")
    back = lambda n: F.lag("q", n, 0).over(w)
    each = each.withColumn("a", back(1)).withColumn("b", back(2)).withColumn("c", back(3))
    fallen = F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 5
    bits = (F.shiftleft(F.greatest("b", "c"), 6) + F.col("a")).bitwiseAND(4095)
    steps = F.shiftleft(F.least(F.lit(7), F.shiftright(fallen.cast("int"), 3)), 13)
    place = F.shiftleft(F.least(F.col("i") + 14, F.lit(127)).bitwiseAND(120), 13)
    context = bits + F.shiftleft((F.col("b") == F.col("c")).cast("int"), 12) + steps + place
    return each.select(key, "i", F.when(F.col("i") == 0, 0).otherwise(context).alias("context"), "q")
