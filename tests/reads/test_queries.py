"""Every registered query with SQL against DuckDB on small tables; streams against batch results."""

from __future__ import annotations

import collections
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from readloom.operators import stats
from readloom.plans import registry
from readloom.plans.adapters import Q
from readloom.streaming import reads as streams


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def bag(rows):
    return collections.Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert bag(tuple(r) for r in got.select(names).collect()) == bag(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_lossy_equals_walk(spark, sf_dir, duck):
    """q_lossy has no SQL: its rows against the walk over codes that are counted here."""
    texts = dict(duck.execute(f"WITH {Q} SELECT doc_id, qual FROM q").fetchall())
    counts = collections.Counter(ord(c) for qual in texts.values() if qual != "*" for c in qual)
    least = min(counts)
    walked = stats.lossy_table(counts, 33 if least < 59 else 59 if least < 64 else 64, 30)
    got = {r["doc_id"]: r["qual"] for r in registry.QUERIES["q_lossy"](spark, sf_dir).collect()}
    assert got == {k: "".join(chr(walked[ord(c)]) for c in qual) for k, qual in texts.items()}


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def _drain(frame, name, folder):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name).collect()


def test_stream_of_mates(spark, tmp_path):
    rows = [("a", 1, 10, 30, 25, 0), ("a", 2, 30, 10, -25, 1), ("b", 3, 5, 9, 7, 1), ("b", 4, 9, 5, -6, 2), ("c", 5, 1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "rname string, row long, pos long, ploc long, tlen long, s int")
    df = df.withColumn("t", F.timestamp_seconds(F.col("s") * 60 + 86400))  # time 0 would be late: the first watermark is 0
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [(r.rname, r.first_row, r.second_row) for r in _drain(streams.open_mates(stream, "t"), "open_mates", tmp_path)] == [("a", 1, 2)]


def test_append_to_store(spark, tmp_path):
    df = spark.createDataFrame([("c1", 5), ("c1", 7), ("c2", 1)], "chr string, pos long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart repeats nothing
        q = streams.append_to_store(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("chr", "pos").collect()
    assert sorted(tuple(r) for r in got) == [("c1", 5), ("c1", 7), ("c2", 1)]


def test_settled_bases(spark, tmp_path):
    """A place is counted whole over micro-batches, once the newest place is far enough ahead; the rest stays state."""
    for places in ([1, 2, 3, 3], [3, 5, 6], [20, 21]):
        df = spark.createDataFrame([(p, "A") for p in places], "place long, base string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("place long, base string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _drain(streams.settled_bases(stream, "place", 10), "settled", tmp_path)
    assert sorted((r.place, r.n) for r in got) == [(1, 1), (2, 1), (3, 3), (5, 1), (6, 1)]


def test_late_rows(spark, tmp_path):
    pytest.importorskip("pandas")
    for i, values in enumerate([[1, 5, 3], [4, 9]]):
        spark.createDataFrame([("c", v) for v in values], "chr string, pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chr string, pos long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.late_rows(stream, "chr", "pos").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.pos, r.late) for r in spark.table("late").collect()) == [(1, False), (3, True), (4, True), (5, False), (9, False)]
