"""The read store: Parquet sorted by position, with side tables for statistics, blocks and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from readloom.operators import columns, stats
from readloom.operators.pileup import with_spans


def write_store(
    reads: DataFrame,
    path: str,
    header: DataFrame | None = None,
    names: list[str] | None = None,
    block_rows: int = columns.BLOCK_ROWS,
    lossy_percent: float = 0,
    lossy_scope: str = "all",
    codec: str = "zstd",
    overwrite: bool = False,
) -> None:
    """Writes reads (schema READS) as a store: `reads` by file and contig, sorted by position inside; `flags`, `blocks`,
    `spans`, `files` and `header` beside it.

    Ranges of (file, contig, position) are dealt to tasks by sampled bounds, so a long contig is split over tasks. A
    block is a stretch of such a part.
    """
    mode = "overwrite" if overwrite else "error"
    spark = reads.sparkSession
    full = with_spans(stats.quantise(reads, "qual", lossy_percent, lossy_scope, block_rows) if lossy_percent else reads)
    order = ["file_id", "chr", "pos", "row_id"]
    placed = full.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    placed = columns.assign_blocks(placed, ["file_id", "chr", "part"], ["pos", "row_id"], block_rows)
    # parts are ranges of the order, so these numbers follow it within a contig
    placed = placed.withColumn("block_id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("block_id"))
    writer = placed.drop("part", "ops").sortWithinPartitions(*order).write.mode(mode).option("compression", codec)
    writer.partitionBy("file_id", "chr").parquet(f"{path}/reads")
    stored = read_store(spark, path)
    stats.flag_histogram(stored, ["file_id"]).write.mode(mode).parquet(f"{path}/flags")
    columns.block_index(stored, ["file_id", "chr"]).write.mode(mode).parquet(f"{path}/blocks")
    stored.groupBy("file_id", "chr").agg(F.max("ref_span").alias("max_ref_span"), F.min("row_id").alias("first_row")).write.mode(mode).parquet(f"{path}/spans")
    n = (reads.agg(F.max("file_id")).first()[0] or 0) + 1
    labels = [(i, (names or [])[i] if i < len(names or []) else str(i)) for i in range(n)]
    spark.createDataFrame(labels, "file_id int, name string").write.mode(mode).parquet(f"{path}/files")
    if header is None:
        header = spark.createDataFrame([], "file_id int, line_no long, record_type string, attrs map<string,string>, raw string")
    header.write.mode(mode).parquet(f"{path}/header")


def read_store(spark: SparkSession, path: str, table: str = "reads") -> DataFrame:
    """A table of a store. Contig names are read as text, so `01` and `1e5` stay what they are."""
    df = spark.read.parquet(f"{path}/{table}")
    if table != "reads":
        return df
    kinds = {"file_id": IntegerType(), "chr": StringType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema])
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def contig_ranks(spark: SparkSession, path: str, by_header: bool = False) -> DataFrame:
    """(chr, id): contigs by first appearance, or in the order of the header's @SQ lines."""
    if by_header:
        lines = read_store(spark, path, "header").where("record_type = 'SQ'").select(F.col("attrs")["SN"].alias("chr"), F.struct("file_id", "line_no").alias("at"))
    else:
        lines = read_store(spark, path, "spans").select(F.col("chr").cast("string").alias("chr"), F.struct("file_id", "first_row").alias("at"))
    first = lines.groupBy("chr").agg(F.min("at").alias("at"))
    return first.select("chr", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("id"))  # one row a contig


def contig_listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, chr, reads, length): contigs of each file that have reads, from the side tables; length is what the file's header
    gives, null without."""
    reads = read_store(spark, path, "blocks").groupBy("file_id", F.col("chr").cast("string").alias("chr")).agg(F.sum("n_rows").alias("reads"))
    lines = read_store(spark, path, "header").where("record_type = 'SQ'")
    lengths = lines.groupBy("file_id", F.col("attrs")["SN"].alias("chr")).agg(F.max(F.col("attrs")["LN"].try_cast("bigint")).alias("length"))
    return reads.join(lengths, ["file_id", "chr"], "left")
