"""Views of ordinary tables in the shape of reads, the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What orders reads as in a file; line numbers alone repeat within an order.
ORDER = ["oid", "ln", "pk", "cents", "pos"]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads: an order is a name, the supplier gives the contig, the ship date the position and the quantity the
    span. ORDER is their order in the file."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('R', l_orderkey) as rname",
        "concat('chr', l_suppkey % 5) as chr",
        "cast(datediff(l_shipdate, timestamp '1995-01-01') as bigint) as pos",
        "cast(l_quantity as bigint) as span",
        "cast(l_linenumber % 8 + if(l_returnflag = 'R', 16, 0) + if(l_linestatus = 'O', 32, 0) as int) as flag",
        "l_orderkey as oid",
        "cast(l_linenumber as bigint) as ln",
        "l_partkey as pk",
        "cast(round(l_extendedprice * 100) as bigint) as cents",
    ).withColumn("end_excl", F.col("pos") - 1 + F.col("span"))


R = """r AS (
  SELECT concat('R', l_orderkey) AS rname, concat('chr', l_suppkey % 5) AS chr,
         CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS span,
         CAST(l_linenumber % 8 + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 32 ELSE 0 END AS INTEGER) AS flag,
         l_orderkey AS oid, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) - 1 + CAST(l_quantity AS BIGINT) AS end_excl
  FROM lineitem)"""


def mated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with mate fields: reads 1 and 2, 3 and 4, ... of an order point at each other; every third order's tlen is off by
    one and every seventh's by two. Contig and name are the order's, row is the place in it."""
    base = reads(spark, sf_dir).withColumn("chr", F.concat(F.lit("chr"), F.col("oid") % 5))
    base = base.withColumn("ln", F.row_number().over(Window.partitionBy("oid").orderBy(*ORDER[1:])).cast("long"))
    w = Window.partitionBy("oid", F.floor((F.col("ln") - 1) / 2)).orderBy("ln")
    first = F.row_number().over(w) == 1
    other = lambda c: F.when(first, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    out = base.withColumn("first", first).withColumn("o_pos", other("pos")).withColumn("o_span", other("span"))
    off = F.when(F.col("oid") % 7 == 0, 2).when(F.col("oid") % 3 == 0, 1).otherwise(0)
    size = F.when(F.col("first"), F.col("o_pos") + F.col("span") - F.col("pos")).otherwise(F.col("pos") + F.col("o_span") - F.col("o_pos")) - off
    return out.select(
        "rname", "oid", "chr", "pos", "span", "flag", F.col("ln").alias("row"),
        F.when(F.col("o_pos").isNull(), "*").otherwise("=").alias("pchr"),
        F.coalesce("o_pos", F.lit(0)).alias("ploc"),
        F.coalesce(F.when(F.col("first"), size).otherwise(-size), F.lit(0)).alias("tlen"),
    )


M = (
    R
    + """,
o AS (SELECT * REPLACE (row_number() OVER (PARTITION BY oid ORDER BY ln, pk, cents, pos) AS ln) FROM r),
m0 AS (
  SELECT rname, oid, concat('chr', oid % 5) AS chr, pos, span, flag, ln,
         row_number() OVER w = 1 AS f,
         CASE WHEN row_number() OVER w = 1 THEN lead(pos) OVER w ELSE lag(pos) OVER w END AS o_pos,
         CASE WHEN row_number() OVER w = 1 THEN lead(span) OVER w ELSE lag(span) OVER w END AS o_span
  FROM o WINDOW w AS (PARTITION BY oid, (ln - 1) // 2 ORDER BY ln)),
m1 AS (
  SELECT *, CASE WHEN f THEN o_pos + span - pos ELSE pos + o_span - o_pos END
            - CASE WHEN oid % 7 = 0 THEN 2 WHEN oid % 3 = 0 THEN 1 ELSE 0 END AS size
  FROM m0),
m AS (
  SELECT rname, oid, chr, pos, span, flag, ln AS row, CASE WHEN o_pos IS NULL THEN '*' ELSE '=' END AS pchr,
         coalesce(o_pos, 0) AS ploc, coalesce(CASE WHEN f THEN size ELSE -size END, 0) AS tlen
  FROM m1)"""
)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as aligned reads: the ASCII letters of the text in upper case, on a contig of its language."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "coalesce(lang, '*') as chr", "doc_id % 1000 + 1 as pos", "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '')) as seq"
    )


L = """l AS (
  SELECT doc_id, coalesce(lang, '*') AS chr, doc_id % 1000 + 1 AS pos,
         upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS seq
  FROM documents)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, seq): of each language the letters of the document with the least id."""
    first = letters(spark, sf_dir).where("chr <> '*'").groupBy("chr").agg(F.min("doc_id").alias("doc_id"))
    return letters(spark, sf_dir).select("doc_id", "seq").join(first, "doc_id").select("chr", "seq")


C = """c AS (SELECT chr, seq FROM l WHERE (chr, doc_id) IN (SELECT (chr, min(doc_id)) FROM l WHERE chr <> '*' GROUP BY chr))"""


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as quality strings: the visible ASCII characters of the text."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "cast(doc_id % 32 as int) as flag", "regexp_replace(coalesce(text, ''), '[^!-~]', '') as qual"
    )


Q = """q AS (
  SELECT doc_id, CAST(doc_id % 32 AS INTEGER) AS flag, regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS qual
  FROM documents)"""
