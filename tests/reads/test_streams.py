"""Streams with keyed state over several micro-batches, files that grow, and tables that meet without an exchange."""

from __future__ import annotations

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import buckets, mates, pileup, tiles
from readloom.sources import tail, text
from readloom.streaming import stateful
from tests.reads.test_sources import HEADER, LINES


def batches(spark, folder, frames):
    """A stream that gives one frame after the other."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


MATED = "rname string, row long, chr string, pos long, span long, pchr string, ploc long, tlen long, minute int"


def test_pending_mates_equal_the_fold(spark, tmp_path):
    """Names of many reads in three batches: matches, failures that replace the candidate, candidates that several reads match."""
    rng = random.Random(8)
    rows = []
    for row in range(240):
        name, second = f"n{rng.randint(0, 15)}", rng.random() < 0.5
        pos, ploc, tlen = (20, 10, -15) if second else (10, 20, 15)
        rows.append((name, row, "c1", pos, 5, rng.choice(["=", "c1", "c2"]), ploc, rng.choice([tlen, tlen, 0]), row // 80))
    df = spark.createDataFrame(rows, MATED).withColumn("t", F.timestamp_seconds(F.col("minute") * 60 + 86_400))
    stream = batches(spark, str(tmp_path / "in"), [df.where(F.col("minute") == k) for k in range(3)])
    pairs = drained(stateful.pending_mates(stream, [], "t", "1 day"), str(tmp_path / "out"))
    want = {tuple(r) for r in mates.pair_mates(df, []).collect()}
    assert {tuple(r) for r in mates.both_sides(pairs, []).collect()} == want and len(want) > 40


def test_old_candidates_are_forgotten(spark, tmp_path):
    rows = [("a", 1, "c", 10, 5, "=", 20, 15, 0), ("b", 2, "c", 10, 5, "=", 20, 15, 0), ("a", 3, "c", 20, 5, "=", 10, -15, 5), ("x", 4, "c", 1, 5, "=", 1, 1, 100), ("b", 5, "c", 20, 5, "=", 10, -15, 101)]
    df = spark.createDataFrame(rows, MATED).withColumn("t", F.timestamp_seconds(F.col("minute") * 60 + 86_400))
    stream = batches(spark, str(tmp_path / "in"), [df.where(F.col("row").isin(*k)) for k in ((1, 2), (3,), (4,), (5,))])
    pairs = drained(stateful.pending_mates(stream, [], "t", "10 minutes"), str(tmp_path / "out"))
    assert [tuple(r) for r in pairs.collect()] == [(3, 1, 0)]


def test_pending_mates_cross_by_bucket(spark, tmp_path):
    """Names with nulls, parts of other kinds and large numbers share a bucket, whose state is one value, not one a name."""
    rng, big = random.Random(11), (1 << 53) + 1
    rows = []
    for row in range(300):
        second = rng.random() < 0.5
        pos, ploc, tlen = (big + 10, big, -15) if second else (big, big + 10, 15)
        values = [rng.choice([None, "a", "b"]), big + row, rng.choice(["c1", None]), pos, 5, rng.choice(["=", "c1", None]), ploc, tlen]
        if rng.random() < 0.2:
            values[rng.choice([3, 4, 6, 7])] = None
        rows.append((rng.choice([None, 1, big]), *values, row // 100))
    df = spark.createDataFrame(rows, "part long, " + MATED).withColumn("t", F.timestamp_seconds(F.col("minute") * 60 + 86_400))
    stream = batches(spark, str(tmp_path / "in"), [df.where(F.col("minute") == k) for k in range(3)])
    pairs = drained(stateful.pending_mates(stream, ["part"], "t", "1 day", buckets=2), str(tmp_path / "out"))
    want = {tuple(r) for r in mates.pair_mates(df, ["part"], few=1000).collect()}
    assert {tuple(r) for r in mates.both_sides(pairs, ["part"]).collect()} == want and len(want) > 20


def test_settled_tiles(spark, tmp_path):
    """Tiles come once, whole, when a read begins behind them; what reads can still reach stays state."""
    rng = random.Random(3)
    rows = sorted((k, rng.randint(1, 400)) for k in (0, 1) for _ in range(150))
    rows = [(i, f"c{k}", p, k * 10_000 + p, "".join(rng.choices("ACGT", k=30))) for i, (k, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "n long, chr string, pos long, place long, seq string").withColumn("cigar", F.lit("30M"))
    stream = batches(spark, str(tmp_path / "in"), [df.where(F.floor(F.col("n") / 75) == k) for k in range(4)])
    got = drained(stateful.settled_tiles(stream, "place", chunk=64), str(tmp_path / "out"))
    front = max(r[3] for r in rows) - 10_000
    every = tiles.tile_counts(df, 64)
    done = every.where((F.col("chr") == "c0") | ((F.col("chunk") + 1) * 64 < front))
    shown = lambda x: sorted(tuple(r) for r in tiles.consensus_rows(x, 64).collect())
    assert shown(got) == shown(done) and 0 < done.count() < every.count()
    assert got.groupBy("chr", "chunk").count().where("count > 1").count() == 0


def test_growing_files(spark, tmp_path):
    """A stream that is stopped and started again, over a file whose last line is not whole, gives every line once."""
    folder = tmp_path / "in"
    folder.mkdir()
    a, b = folder / "a.sam", folder / "b.sam"
    (folder / "note.txt").write_text("not read\n")

    def run():
        stream = tail.tail_sam(spark, str(folder), split_bytes=100).select("path", "row_id", text.sam_line().alias("line"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        return q

    def rows():
        return sorted((os.path.basename(r.path), r.row_id, r.line) for r in spark.read.parquet(str(tmp_path / "rows")).collect())

    whole = "\n".join([*HEADER, *LINES]) + "\n"
    a.write_text(whole[:-40])
    q = run()
    with a.open("a") as f:
        f.write(whole[-40:] + LINES[0])
    q.processAllAvailable()
    q.stop()
    assert [x for _, _, x in rows()] == LINES
    with a.open("a") as f:
        f.write("\n" + LINES[1] + "\n")
    b.write_text(whole)
    q = run()
    q.stop()
    run().stop()
    want = [("a.sam", line) for line in [*LINES, LINES[0], LINES[1]]] + [("b.sam", line) for line in LINES]
    assert [(p, x) for p, _, x in rows()] == want


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_lines_by_ranges(size):
    data = b"a\n\nlong line\n" + b"x" * 50 + b"\nlast\n"
    cut = [r for k in range(0, len(data), size) for r in tail.lines(io.BytesIO(data), k, min(len(data), k + size))]
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert cut == want
    assert tail.whole_lines(io.BytesIO(data + b"part"), 0, len(data) + 4) == len(data)
    assert tail.whole_lines(io.BytesIO(b"part"), 0, 4) == 0


def test_bucketed_reference_has_no_exchange(spark):
    rng = random.Random(6)
    ref = {"c1": "".join(rng.choices("ACGT", k=1000)), "c2": "ACG"}
    chunks = pileup.reference_chunks(spark.createDataFrame(list(ref.items()), "chr string, seq string"), 64)
    rows = [(i, rng.choice(["c1", "c2", "c3", "*"]), rng.randint(1, 1100), rng.randint(0, 90)) for i in range(300)]
    df = spark.createDataFrame([(i, c, p, p - 1 + n) for i, c, p, n in rows], "id long, chr string, pos long, end_excl long")
    names = [f"t{rng.getrandbits(40):x}" for _ in range(2)]
    bases, reads = buckets.save_reference(chunks, names[0], 4, reach=70, chunk=64), buckets.save_reads(df, names[1], 4, chunk=64)
    want = {r.id: r.ref for r in pileup.with_reference(df, chunks, ["id"], 64).collect()}
    short = buckets.with_bucketed_reference(reads.where("end_excl - pos + 1 <= 70"), bases, ["id"], reach=70, chunk=64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = short._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Join" in plan
    assert {r.id: r.ref for r in short.collect()} == {i: want[i] for i, _, _, n in rows if n <= 70}
    every = buckets.with_bucketed_reference(reads, bases, ["id"], chunks, reach=70, chunk=64)
    assert {r.id: r.ref for r in every.collect()} == want
    with pytest.raises(Exception, match="longer than the reach"):
        buckets.with_bucketed_reference(reads, bases, ["id"], reach=70, chunk=64).collect()
    patches = spark.createDataFrame([("c1", 1, "G"), ("c1", 64, "."), ("c1", 65, "T"), ("c2", 3, "A"), ("c2", 9, "A")], "chr string, pos long, alt string")
    made = {}
    for r in buckets.patched_chunks(chunks, patches, 64).collect():
        made.setdefault(r.chr, []).append((r.chunk, r.bases))
    one = list(ref["c1"])
    one[0], one[63], one[64] = "G", ".", "T"
    assert {c: "".join(b for _, b in sorted(x)) for c, x in made.items()} == {"c1": "".join(one), "c2": "ACA"}
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_frequent_names_pass_in_order(spark):
    """Names of many reads by the stream, of which some are one run of matches, equal the fold over their sorted reads."""
    rng = random.Random(4)
    rows = [("*", i, "*", 0, 0, "*", 0, 0) for i in range(300)]
    for i in range(300, 900):
        second = rng.random() < 0.6
        pos, ploc, tlen = (20, 10, -15) if second else (10, 20, 15)
        rows.append((rng.choice(["hot", "hot", "b"]), i, "c1", rng.choice([pos, pos, pos, None]), 5, rng.choice(["=", "c1", "c1", None]), ploc, tlen))
    df = spark.createDataFrame(rows, "rname string, row long, chr string, pos long, span long, pchr string, ploc long, tlen long").withColumn("block", F.lit(3)).repartition(5)
    want = {tuple(r) for r in mates.pair_mates(df, ["block"], 1 << 20).collect()}
    assert {tuple(r) for r in mates.pair_mates(df, ["block"], 2).collect()} == want
    assert {tuple(r) for r in mates.pair_mates(df, ["block"], 350).collect()} == want and len(want) > 300
