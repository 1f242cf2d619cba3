"""Text sources and sinks: alignment lines, headers, FASTA and FASTQ names."""

from __future__ import annotations

import os
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.fields import header_attributes, name_and_comment, parse_tags, tag_text
from readloom.operators import ordered
from readloom.schema import LINE
from readloom.sources.fasta import fasta_chunks

#: Bytes of a file that tell its format.
SNIFFED = 1 << 12
#: Reference files that a header may name.
MAX_FILES = 10_000


def numbered_lines(spark: SparkSession, paths: list[str], line_sep: str | None = None) -> DataFrame:
    """(file_id, line_no, value): lines of text files, numbered from 0 in each; file_id is the place in `paths`.

    Lines are numbered inside each input split, and splits by the count of lines before them, so no task sees a whole
    file. The files of a folder follow one another by name. The ids within a split follow the order of reading.
    """
    out = None
    for i, path in enumerate(paths):
        lines = spark.read.text(path, lineSep=line_sep).select(
            F.lit(i).alias("file_id"),
            F.col("_metadata.file_path").alias("path"),
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("no paths")
    split = ["file_id", "file", "block"]
    own = out.drop("path").withColumn("n", F.row_number().over(Window.partitionBy(*split).orderBy("id")) - 1)
    sizes = out.groupBy(*split).agg(F.count("*").alias("size"), F.min("path").alias("path"))
    before = F.sum("size").over(Window.partitionBy("file_id").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*split, F.coalesce(before, F.lit(0)).alias("start"))
    return own.join(starts, split).select("file_id", (F.col("start") + F.col("n")).alias("line_no"), "value")


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of alignment text files, in schema READS; row_id is the line number. Numbers that are none become null,
    missing fields too; a last line without a line end counts."""
    return reads_of_lines(numbered_lines(spark, [paths] if isinstance(paths, str) else paths))


def reads_of_lines(lines: DataFrame, *more: str) -> DataFrame:
    """Reads, in schema READS with more columns in front, of lines (file_id, line_no, value, more...); headers and empty lines are left out."""
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    part = F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t")
    field = lambda i: F.get(part, F.lit(i))
    tags = F.filter(F.slice(part, 12, F.greatest(F.size(part), F.lit(1))), lambda t: t != "")
    kinds = {"flag": "int", "pos": "bigint", "mapq": "int", "ploc": "bigint", "tlen": "int"}
    columns = [field(i).try_cast(kinds[n]).alias(n) if n in kinds else field(i).alias(n) for i, n in enumerate(LINE)]
    return rows.select(*more, "file_id", F.col("line_no").alias("row_id"), *columns, parse_tags(tags).alias("tags"))


def read_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Header lines of alignment text files, in schema HEADERS."""
    lines = numbered_lines(spark, [paths] if isinstance(paths, str) else paths).where(F.col("value").startswith("@"))
    parsed = header_attributes(F.col("value"))
    return lines.select("file_id", "line_no", parsed["record_type"].alias("record_type"), parsed["attrs"].alias("attrs"), F.col("value").alias("raw"))


def header_registry(header: DataFrame, kind: str) -> DataFrame:
    """(file_id, name, attrs) of the @SQ lines by SN, of @RG and @PG lines by ID."""
    key = "SN" if kind == "SQ" else "ID"
    return header.where(F.col("record_type") == kind).select("file_id", F.col("attrs")[key].alias("name"), "attrs")


def sam_line(no_quality: bool = False) -> Column:
    """A read's line of text. Without qualities, `@` stands for each base."""
    fields = {n: F.col(n).cast("string") for n in LINE}
    if no_quality:
        fields["qual"] = F.repeat(F.lit("@"), F.length("seq"))
    tags = F.transform("tags", tag_text)
    return F.concat_ws("\t", *(F.coalesce(fields[n], F.lit("*")) for n in LINE), F.when(F.size(tags) > 0, F.array_join(tags, "\t")))


def write_sam(reads: DataFrame, path: str, header: DataFrame | None = None, order: list[str] | None = None, no_quality: bool = False) -> None:
    """Writes reads as text, a folder for each file_id; with `header`, its lines come first. Rows are range-partitioned
    by `order` (row_id unless given), so part files follow one another."""
    order = order or ["row_id"]
    body = reads.select("file_id", F.lit(1).alias("part"), *order, sam_line(no_quality).alias("value"))
    if header is not None:
        first = [F.col("line_no").cast(body.schema[c].dataType).alias(c) if i == len(order) - 1 else F.lit(None).cast(body.schema[c].dataType).alias(c) for i, c in enumerate(order)]
        body = header.select("file_id", F.lit(0).alias("part"), *first, F.col("raw").alias("value")).unionByName(body)
    keys = ["file_id", "part", *order]
    body.repartitionByRange(*keys).sortWithinPartitions(*keys).select("file_id", "value").write.partitionBy("file_id").text(path)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chr, seq) of FASTA files, a row for each contig, upper case; the name ends at the first white space."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(name.alias("chr"), F.upper(body).alias("seq"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, line_bases, line_width) of a FASTA file's contigs: offset of the first base in bytes. Lines and their
    bytes are counted by input split, so no task sees a whole genome."""
    lines = numbered_lines(spark, [path], "\n").withColumn("name", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1)))
    size = (F.octet_length("value") + 1).cast("long")
    placed = ordered.running_sum(ordered.ranged(lines, ["file_id"], ["line_no"]), ["file_id"], size, "end")
    placed = ordered.filled(placed.withColumnRenamed("name", "_name"), ["file_id"], "_name", "name")
    bare = F.rtrim("value", F.lit(" \r"))
    body = placed.where(~F.col("value").startswith(">") & F.col("name").isNotNull()).select("name", F.col("line_no").alias("no"), bare.alias("line"), size.alias("size"), (F.col("end") - size).alias("at"))
    return body.groupBy("name").agg(
        F.sum(F.length("line")).alias("length"),
        F.min("at").alias("offset"),
        F.min_by(F.length("line"), "no").cast("int").alias("line_bases"),
        F.min_by("size", "no").cast("int").alias("line_width"),
    )


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")


def resolve_reference(spark: SparkSession, header: DataFrame | None = None, path: str | None = None, contigs: list[str] | None = None) -> DataFrame | None:
    """(chr, chunk, bases) of the reference: a FASTA file or, for a path that ends in `/`, `<contig>.fa` files in it; else the URLs
    that @SQ lines give; None if there is neither, and all bases are N. Of a folder, contigs without a file have no bases."""
    if path and path.endswith("/"):
        if contigs is None:
            raise ValueError("a folder of contigs needs their names")
        found = [f"{path}{c}.fa" for c in contigs if c != "*"]
        found = [p for p in found if exists(spark, p)]
    elif path:
        found = [path]
    elif header is not None:
        urls = header_registry(header, "SQ").select(F.col("attrs")["UR"].alias("u")).where("u is not null").distinct().limit(MAX_FILES + 1)
        found = sorted(r["u"] for r in urls.collect())
        if len(found) > MAX_FILES:
            raise ValueError(f"the header names more than {MAX_FILES} reference files; give one file or a folder")
    else:
        found = []
    return fasta_chunks(spark, found) if found else None


def exists(spark: SparkSession, path: str) -> bool:
    """A file is there, in any file system of the session."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_fastq_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, read_no, name, comment) of FASTQ files of four lines a record."""
    lines = numbered_lines(spark, [paths] if isinstance(paths, str) else paths).where("line_no % 4 = 0")
    parts = name_and_comment(F.regexp_replace("value", "^@", ""))
    return lines.select("file_id", F.floor(F.col("line_no") / 4).alias("read_no"), parts["name"].alias("name"), parts["comment"].alias("comment"))


def sniff(spark: SparkSession, path: str) -> str:
    """`bam`, `store` or `sam`, by the first bytes of a file, or `store` for a folder; read through the session's file systems,
    so any path that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isDirectory():
        return "store"
    stream = files.open(at)
    try:
        head = bytes(stream.readNBytes(SNIFFED))
    finally:
        stream.close()
    if head[:2] == b"\x1f\x8b":
        return "bam" if zlib.decompressobj(31).decompress(head, 4) == b"BAM\x01" else "sam"
    return "sam"


def remove_extension(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path)


def full_path(path: str) -> str:
    """An absolute path; what names a file system is one already."""
    return path if "://" in path else os.path.abspath(path)


def is_s3(path: str) -> bool:
    return bool(re.match(r"s3[an]?://|https?://([^/]+\.)?s3[.-][^/]*/", path))


def is_web(path: str) -> bool:
    return bool(re.match(r"(https?|ftp|s3a?)://", path))
