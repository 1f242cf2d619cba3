"""Ordered operators whose contigs lie in many tasks, against plain walks; tags that a reference gives."""

from __future__ import annotations

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from readloom.api import ReadStore
from readloom.operators import ordered, ranges
from readloom.sources import text


@pytest.fixture
def rows(spark):
    """One contig of two thirds of all rows, small ones, one without a name; more tasks than some contigs have rows."""
    rng = random.Random(4)
    data = [(c, i, rng.choice([0, 1, 5, 253, 254, 255, 900]) + 3 * i, rng.choice("xxxy")) for c, n in (("big", 200), ("one", 1), ("two", 2), (None, 60)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield data, spark.createDataFrame(data, "chr string, i long, v long, k string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ordered_equal_plain_walks(spark, rows):
    data, df = rows
    assert ordered.ranged(df, ["chr"], ["i"]).where("chr = 'big'").select(ordered.PART).distinct().count() > 1
    want = {}
    for _, own in groupby(data, key=lambda r: r[0]):
        last, late, run, before = 0, 0, 0, None
        for n, (c, i, v, k) in enumerate(own):
            d = v - last
            run += before is not None and k != before
            want[c, i] = (n, (255, v) if d < 0 or d >= 254 else (d, None), run)
            last, before = v, k
    got = {(r.chr, r.i): r.row_no for r in ordered.row_numbers(df, ["chr"], ["i"]).collect()}
    assert got == {k: w[0] for k, w in want.items()}
    coded = ordered.delta(df, "v", ["chr"], ["i"])
    assert {(r.chr, r.i): (r.delta, r.escape) for r in coded.collect()} == {k: w[1] for k, w in want.items()}
    assert all(r.v == r.back for r in ordered.delta_inverse(coded, ["chr"], ["i"], "back").collect())
    assert {(r.chr, r.i): r.run_id for r in ordered.run_ids(df, "k", ["chr"], ["i"]).collect()} == {k: w[2] for k, w in want.items()}
    late = {r.chr: r.n_unsorted for r in ordered.unsorted_rows(df, "v", ["chr"], ["i"]).collect()}
    for c in ("big", "one", "two", None):
        own = [r[2] for r in data if r[0] == c]
        assert late[c] == sum(b < a for a, b in zip(own, own[1:], strict=False))
    empty = df.limit(0)
    assert ordered.delta_inverse(ordered.delta(empty, "v", ["chr"], ["i"]), ["chr"], ["i"]).count() == 0


def test_patch_deltas(spark):
    at = [3, 4, 257, 258 + 253, 511 + 254, 765 + 255, 10_000]
    df = spark.createDataFrame([("c", p) for p in at], "chr string, pos long").repartition(3)
    coded = ordered.patch_delta(df, ["chr"])
    got = [(r.delta, r.escape) for r in coded.orderBy("pos").collect()]
    steps = [b - a for a, b in zip([0, *at], at, strict=False)]
    assert got == [(254, d - 253) if d >= 254 else (d, None) for d in steps]
    assert all(r.pos == r.back for r in ordered.patch_delta_inverse(coded, ["chr"], ["pos"], "back").collect())


def test_store_with_a_reference(spark, tmp_path):
    """Tags that the reference gives are not stored, come back where they stood, and wrong ones stay and are counted."""
    (tmp_path / "ref.fa").write_text(">c1 first\nACGTACGTAC\nGTACGTACGT\n>c2\nTTTTTTTTTT\n")
    lines = [
        "a\t0\tc1\t1\t9\t8M\t*\t0\t0\tACGTACGT\tIIIIIIII\tXA:A:x\tMD:Z:8\tNM:i:0\tRG:Z:g",
        "b\t0\tc1\t3\t9\t4M\t*\t0\t0\tGAAC\tIIII\tNM:i:1\tMD:Z:1T2",
        "c\t0\tc2\t2\t9\t4M\t*\t0\t0\tTTTT\tIIII\tNM:i:3\tMD:Z:4",
        "d\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tNM:i:0",
    ]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    path, reference = str(tmp_path / "store"), str(tmp_path / "ref.fa")
    opened = ReadStore.ingest(spark, [str(tmp_path / "x.sam")], path, reference=reference)
    stored = {r.rname: [t.tag for t in r.tags] for r in opened.reads.collect()}
    assert stored == {"a": ["XA", "RG"], "b": [], "c": ["NM"], "d": ["NM"]}
    back = opened.query().orderBy("row_id").select(text.sam_line().alias("v")).collect()
    assert [r.v for r in back] == lines
    assert [r.v for r in opened.query("c1:3;c2").orderBy("row_id").select(text.sam_line().alias("v")).collect()] == lines[1:3]
    assert {(r.tag, r.present, r.mismatched) for r in opened.mismatches().collect()} == {("MD", 3, 0), ("NM", 3, 1)}
    with pytest.raises(ValueError, match="with a reference"):
        ReadStore(spark, path).query("c1")
    assert opened.query("c1").select(F.col("rname")).count() == 2


@pytest.mark.parametrize(("n", "most"), [(4, 10), (3, 1000), (1000, 25), (1, 1)])
def test_capped_blocks_over_many_tasks(spark, rows, n, most):
    """One contig over many tasks; blocks that end by rows, by sizes, and that are as long as several tasks."""
    data, df = rows
    sized = df.withColumn("size", F.when(F.col("i") % 11 == 0, 0).otherwise((F.col("v") * 7) % 9))
    want = {}
    for c, own in groupby(data, key=lambda r: r[0]):
        block = count = total = 0
        for _, i, v, _ in own:
            if count >= n or total >= most:
                block, count, total = block + 1, 0, 0
            want[c, i] = block
            count, total = count + 1, total + (0 if i % 11 == 0 else v * 7 % 9)
    out = ordered.assign_capped_blocks(sized, ["chr"], ["i"], "size", n, most)
    assert {(r.chr, r.i): r.block_id for r in out.collect()} == want
    assert set(out.columns) == {*sized.columns, "block_id"}


def test_block_lookup_over_many_tasks(spark, rows):
    index = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 7)], "chr string, first_pos long, block_id int")
    asks = spark.createDataFrame([(c, p) for c in "abc" for p in range(1, 30)], "chr string, at long").repartition(6)
    got = {(r.chr, r.at): r.block_id for r in ranges.block_at(index, asks).collect()}
    want = {"a": lambda p: 2 if p >= 20 else 1 if p >= 10 else None, "b": lambda p: 7 if p >= 5 else None, "c": lambda p: None}
    assert got == {(c, p): want[c](p) for c in "abc" for p in range(1, 30)}


def test_ranges_of_files(spark):
    df = spark.createDataFrame([(f, "c1", p, p + 4) for f in (0, 1) for p in range(1, 20)], "file_id int, chr string, pos long, end_excl long")
    asked = ranges.parse_ranges("1,c1:1-9;0,c1:15-16")
    got = ranges.multi_range(df, ranges.ranges_frame(df, asked), overlap=True, bin_size=4)
    assert sorted((r.range_no, r.file_id, r.pos) for r in got.collect()) == sorted([(0, 1, p) for p in range(1, 10)] + [(1, 0, p) for p in range(11, 17)])
    assert {(r.file_id, r.pos) for r in ranges.any_range(df, asked).collect()} == {(1, p) for p in range(1, 10)} | {(0, 15), (0, 16)}
    bare = df.where("file_id = 0").drop("file_id")
    with pytest.raises(ValueError):
        ranges.any_range(bare, asked)
    with pytest.raises(Exception, match="no file_id"):
        ranges.multi_range(bare, ranges.ranges_frame(bare, asked)).collect()
