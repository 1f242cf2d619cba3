"""Files that are read and written in parts: BAM by ranges and with an index, FASTA by ranges, sinks with a commit."""

from __future__ import annotations

import glob
import gzip
import hashlib
import io
import json
import os
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from readloom.operators import tiles
from readloom.operators.ranges import Range
from readloom.schema import LINE
from readloom.sources import bam, fasta, sinks, text
from tests.reads import fold
from tests.reads.test_sources import HEADER, LINES

CONTIGS = ["c1", "c2", "c3"]
HEAD = ["@HD\tVN:1.6", *(f"@SQ\tSN:{c}\tLN:1000000" for c in CONTIGS), "@CO\tx"]


def sorted_lines(n: int, seed: int = 5) -> list[str]:
    """Lines in coordinate order; some reads are much longer than a compressed block."""
    rng = random.Random(seed)
    at = sorted((rng.choice(CONTIGS), rng.randint(1, 300_000)) for _ in range(n))
    out = []
    for i, (c, pos) in enumerate(at):
        size = 200_000 if i in (40, 41, n - 1) else rng.randint(1, 200)
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(chr(rng.randint(33, 90)) for _ in range(size)) if i % 3 else "*"
        tags = f"\tNM:i:{rng.choice([-5, 3, 200, 40000, 70000, 3_000_000_000])}\tXB:B:S,{','.join('0' * rng.randint(1, 40))}\tXZ:Z:{'word ' * rng.randint(0, 3)}end\tXF:f:0.5\tXA:A:!"
        out.append(f"r{i}\t{rng.choice([0, 16, 99, 147])}\t{c}\t{pos}\t{rng.randint(0, 255)}\t{size}M\t{rng.choice(['=', '*'] + ['c3'] * (c != 'c3'))}\t{rng.randint(0, 9)}\t{rng.randint(-9, 9)}\t{seq}\t{qual}{tags}")
    return [*out, "u\t4\t*\t0\t0\t*\t*\t0\t0\tNNN\t***"]


@pytest.fixture(scope="module")
def big_bam(spark, tmp_path_factory):
    """A file of many blocks, by the library's own sink."""
    top = tmp_path_factory.mktemp("bam")
    (top / "a.sam").write_text("\n".join([*HEAD, *sorted_lines(3000)]) + "\n")
    source = str(top / "a.sam")
    sinks.write_files(text.read_sam(spark, source), str(top / "out"), text.read_header(spark, source), "bam", {0: "a.bam"}, single=True)
    return str(top / "out" / "a.bam")


def lines_of(reads):
    return [r.v for r in reads.orderBy("row_id").select("row_id", text.sam_line().alias("v")).collect()]


def test_bam_written_and_read(spark, big_bam):
    assert lines_of(bam.read_bam(spark, big_bam)) == sorted_lines(3000)
    header, contigs = bam.read_bam_header(spark, big_bam)
    assert [r.raw for r in header.orderBy("line_no").collect()] == HEAD
    assert [r.chr for r in contigs.orderBy("chr_no").collect()] == CONTIGS
    with gzip.open(big_bam) as f:  # any reader of gzip sees one stream
        assert f.read(4) == b"BAM\x01"


@pytest.mark.parametrize("size", [7_001, 65_536, 200_003])
def test_bam_cut_anywhere(spark, big_bam, size):
    whole = bam.read_bam(spark, big_bam, 1 << 40)
    cut = bam.read_bam(spark, big_bam, size)
    assert cut.select(F.spark_partition_id()).distinct().count() >= 4
    assert cut.orderBy("row_id").collect() == whole.orderBy("row_id").collect()


def test_every_record_start_is_found(big_bam):
    """From any block on, the first record found is one of the file's, and the first that begins there."""
    with open(big_bam, "rb") as f:
        size = os.path.getsize(big_bam)
        blocks = bam.Blocks(f, size)
        head = bam._after_header(blocks, _head_bytes(big_bam))
        places = [int(p) for _, _, found in bam.located_records(blocks, head, size << 16) for p in found[:-1]]
        rng = random.Random(2)
        for offset in [0, 1, size - 1, size - 28, *rng.sample(range(size), 20)]:
            want = next((p for p in places if p >> 16 >= blocks.next_block(offset)), size << 16)
            if offset > head >> 16:
                assert bam.first_record(blocks, offset, len(CONTIGS)) == want


def _head_bytes(path):
    with gzip.open(path) as f:
        bam.read_dictionary(f)
        return f.tell()


def test_wrong_ends_are_errors(big_bam):
    size = os.path.getsize(big_bam)
    with open(big_bam, "rb") as f:
        blocks = bam.Blocks(f, size)
        head = bam._after_header(blocks, _head_bytes(big_bam))
        with pytest.raises(ValueError):
            list(bam.located_records(blocks, head, bam.first_record(blocks, size // 2, 3) + 1))
        data = open(big_bam, "rb").read()
    broken = io.BytesIO(data[: size // 3])
    with pytest.raises(ValueError):
        list(bam.located_records(bam.Blocks(broken, size // 3), head, (size // 3) << 16))


def test_index_reads_some_blocks(spark, big_bam):
    bam.index_bam(spark, big_bam, 100_000)
    every = bam.read_bam(spark, big_bam).collect()
    size = os.path.getsize(big_bam)
    for c, low, high in (("c2", 100_000, 120_000), ("c1", 1, 50), ("c3", 299_000, 1 << 30), ("c9", 1, 5), ("c2", 5_000_000, 6_000_000)):
        found = bam.read_bam(spark, big_bam, 50_000).where((F.col("chr") == c) & (F.col("pos") >= low) & (F.col("pos") < high))
        assert sorted(found.collect(), key=lambda r: r.row_id) == [r for r in every if r.chr == c and low <= r.pos < high]
        reader = bam.BamSource({"path": big_bam, "split_bytes": "50000"}).reader(found.schema)
        given = [EqualTo(("chr",), c), GreaterThanOrEqual(("pos",), low), LessThan(("pos",), high)]
        assert list(reader.pushFilters(given)) == given
        parts = [p for p in reader.partitions() if p.begin < p.end]
        with open(big_bam, "rb") as f:
            blocks = bam.Blocks(f, size)
            n = sum(len(s) for p in parts for _, s, _ in bam.located_records(blocks, p.begin, p.end))
        assert blocks.bytes_read < 0.6 * size and n >= found.count()
        spans = {r.row_id: int(r.cigar[:-1]) for r in every if r.cigar != "*"}
        over = bam.read_bam_range(spark, big_bam, Range(c, low, high - 1), overlap=True, split_bytes=50_000)
        assert sorted(r.row_id for r in over.collect()) == [r.row_id for r in every if r.chr == c and r.pos < high and (r.pos >= low or r.pos - 1 + spans[r.row_id] >= low)]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    tags = pa.list_(pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("type", pa.string()), ("value", pa.string())]))
    kinds = {"file_id": pa.int32(), "place": pa.int64(), "flag": pa.int32(), "pos": pa.int64(), "mapq": pa.int32(), "ploc": pa.int64(), "tlen": pa.int32(), "tags": tags}
    names = ["file_id", "place", *LINE, "tags"]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(k, kinds.get(k, pa.string())) for k in names]))


def test_no_search_to_the_end_for_a_long_record(tmp_path):
    """What looks like a record of 500 MB in front of each first one does not have the rest of the file read."""
    rng = random.Random(3)
    fake = struct.pack("<iiiBBHHHiiii", 500 << 20, 0, 0, 2, 0, 4681, 0, 0, 0, -1, -1, 0) + b"x\0"
    value = "C," + ",".join(map(str, fake * 3))
    rows = [
        {"file_id": 0, "place": i, "rname": f"r{i}", "chr": "c1", "pos": i + 1, "seq": "".join(rng.choices("ACGT", k=150)), "qual": "".join(chr(rng.randint(33, 126)) for _ in range(150)),
         "tags": [{"pos": 0, "tag": "XB", "type": "B", "value": value}]}
        for i in range(12_000)
    ]
    body = sinks._Bam(pa.OSFile(str(tmp_path / "a.bam"), "w"), "@SQ\tSN:c1\tLN:1000000\n")
    body.head()
    body.add(_batch(rows))
    body.end()
    body.tail()
    body.sink.close()
    size = os.path.getsize(tmp_path / "a.bam")
    with open(tmp_path / "a.bam", "rb") as f:
        blocks = bam.Blocks(f, size)
        head = bam._after_header(blocks, _head_bytes(tmp_path / "a.bam"))
        places = [int(p) for _, _, found in bam.located_records(blocks, head, size << 16) for p in found[:-1]]
        assert len(places) == len(rows)
        for offset in range(1 << 16, size - (1 << 17), size // 9):
            own = bam.Blocks(f, size)
            assert bam.first_record(own, offset, 1) == next(p for p in places if p >> 16 >= own.next_block(offset))
            assert own.bytes_read < 1 << 19 < size / 3


def test_parts_of_several_tasks_are_one_file(spark, tmp_path):
    """A file of BAM is written by as many tasks as there are: the commit lays their blocks end to end."""
    rows = [{"file_id": i // 300, "place": i, "rname": f"r{i}", "chr": "c1", "pos": i + 1, "cigar": "3M", "seq": "ACG", "qual": "III", "tags": []} for i in range(600)]
    options = {"path": str(tmp_path / "out"), "single": "True", "headers": json.dumps({k: "@SQ\tSN:c1\tLN:1000\n" for k in "012"})}
    writer = sinks._Writer("bam", options, False)
    told = [writer.write(iter([_batch(rows[a : a + 90]), _batch(rows[a + 90 : a + 200])])) for a in (400, 0, 200)]
    writer.commit(told)
    assert sorted(os.listdir(tmp_path / "out")) == ["0.bam", "1.bam", "2.bam"]
    back = bam.read_bam(spark, [str(tmp_path / "out" / f"{i}.bam") for i in range(3)]).orderBy("file_id", "row_id")
    assert [(r.file_id, r.rname) for r in back.collect()] == [(i // 300, f"r{i}") for i in range(600)]


def test_sinks_give_the_input(spark, tmp_path):
    for i, lines in enumerate((LINES, [x.replace("p1", "p2") for x in LINES] * 50)):
        (tmp_path / f"{i}.sam").write_text("\n".join([*HEADER, *lines]) + "\n")
    paths = [str(tmp_path / f"{i}.sam") for i in (0, 1)]
    reads, header = text.read_sam(spark, paths), text.read_header(spark, paths)
    sinks.write_files(reads.repartition(7), str(tmp_path / "one"), header, single=True, names={0: "first.sam"})
    assert sorted(os.listdir(tmp_path / "one")) == ["1.sam", "first.sam"]
    for name, i in (("first.sam", 0), ("1.sam", 1)):
        assert (tmp_path / "one" / name).read_bytes() == (tmp_path / f"{i}.sam").read_bytes()
    sinks.write_files(reads.repartition(7), str(tmp_path / "parts"), header)
    for i in (0, 1):
        parts = sorted(glob.glob(str(tmp_path / "parts" / f"{i}.sam" / "part-*")))
        assert b"".join(open(p, "rb").read() for p in parts) == (tmp_path / f"{i}.sam").read_bytes()
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_files(reads, str(tmp_path / "parts"), header)
    assert sorted(os.listdir(tmp_path / "parts")) == ["0.sam", "1.sam"]
    sinks.write_files(reads.where("file_id = 0"), str(tmp_path / "parts"), header, overwrite=True, single=True)
    assert (tmp_path / "parts" / "0.sam").read_bytes() == (tmp_path / "0.sam").read_bytes()
    assert (tmp_path / "parts" / "1.sam").read_text() == "\n".join(HEADER) + "\n"  # a file without rows


def test_failed_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join([*HEADER, *LINES]) + "\n")
    reads = text.read_sam(spark, str(tmp_path / "a.sam"))
    bad = reads.withColumn("chr", F.when(F.col("row_id") == 6, F.raise_error(F.lit("no"))).otherwise(F.col("chr")))
    for kind in ("sam", "bam"):
        out = tmp_path / f"out-{kind}"
        with pytest.raises(Exception, match="no"):
            sinks.write_files(bad.repartition(4), str(out), text.read_header(spark, str(tmp_path / "a.sam")), kind)
        assert not out.exists() or os.listdir(out) == []


# --- FASTA


def plain_contigs(data: str) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for line in data.split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += "".join(line.split()).upper()
    return [(c, s) for c, s in out]


@pytest.mark.parametrize("seed", range(4))
def test_fasta_cut_anywhere(spark, tmp_path, seed):
    rng = random.Random(seed)
    made = "orphan\n" if seed == 1 else ""
    for i in range(6):
        seq = "".join(rng.choices("acgtNACGT", k=rng.choice([0, 1, 63, 64, 500, 3000])))
        width = rng.choice([1 << 20, 1, 7, 60])
        end = rng.choice(["\n", "\r\n"]) if seed == 2 else "\n"
        made += f">c{i} a{'long ' * rng.choice([0, 40])} name{end}" + "".join(seq[k : k + width] + end for k in range(0, len(seq), width))
    made = made.rstrip("\n") if seed == 3 else made
    path = tmp_path / "r.fa"
    path.write_bytes(made.encode())
    want = {c: s for c, s in plain_contigs(made) if s}
    rows = []
    for size in (1, 13, 200, 1 << 20):
        if size == 1 and seed:
            continue
        rows = fasta.fasta_chunks(spark, str(path), 64, size).collect() if size == 200 else rows
        with open(path, "rb") as f:
            n = os.path.getsize(path)
            cut = [p for a in range(0, n, size) for p in fasta.pieces(f, a, min(n, a + size))]
        out: list[list[str]] = []
        for _, name, bases in cut:
            if name is not None:
                out.append([name, ""])
            elif out:
                out[-1][1] += bases
        assert {c: s for c, s in out if s} == want
        if rows:
            held: dict[str, list] = {}
            for r in rows:
                held.setdefault(r.chr, []).append((r.chunk, r.bases))
            assert {c: "".join(b for _, b in sorted(x)) for c, x in held.items()} == want
            assert all(len(b) == 64 for x in held.values() for _, b in sorted(x)[:-1])
    digests = {r.chr: (r.length, r.md5) for r in fasta.chunk_digests(spark.createDataFrame(rows)).collect()}
    assert digests == {c: (len(s), hashlib.md5(s.encode()).hexdigest()) for c, s in want.items()}


def test_fasta_of_gzip_and_folders(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fa").write_text(">a\nAC\n")
    (tmp_path / "f" / "_hidden").write_text(">x\nAC\n")
    (tmp_path / "f" / "b.fa.gz").write_bytes(gzip.compress(b">b\nGG\nTT\n>c\nA\n"))
    assert {(r.chr, r.bases) for r in fasta.fasta_chunks(spark, str(tmp_path / "f")).collect()} == {("a", "AC"), ("b", "GGTT"), ("c", "A")}
    (tmp_path / "empty.fa").write_text("")
    assert fasta.fasta_chunks(spark, str(tmp_path / "empty.fa")).collect() == []


# --- tiles


def test_tiles_equal_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        ops = [(rng.choice("MIDNS=XHP"), rng.randint(0, 9)) for _ in range(rng.randint(1, 6))]
        cigar = "".join(f"{n}{o}" for o, n in ops)
        size = sum(n for o, n in ops if o in "MIS=X") - rng.choice([0, 0, 0, 2])
        rows.append((rng.choice(["c1", "c2", "*"]), rng.randint(1, 200), cigar, "".join(rng.choices("ACGTNacgtR", k=max(size, 0))) or "*"))
    rows += [("c1", 5, "*", "ACG"), ("c1", None, "3M", "ACG"), (None, 5, "3M", "ACG"), ("c1", 5, None, "ACG"), ("c1", 0, "3M", "ACG"), ("c1", 7, "3M", None), ("c1", 7, "3M", "")]
    rows += [("c2", 60, "10M", "ACGTACGTAC")] * 500  # a deep position
    df = spark.createDataFrame(rows, "chr string, pos long, cigar string, seq string").withColumn("counts", F.lit(1)).repartition(5)
    want: dict = {}
    for c, pos, cigar, seq in rows:
        if c in (None, "*") or not pos or cigar in (None, "*") or seq in (None, "*", ""):
            continue
        ref, read = pos, 0
        for o, n in fold.ops_of(cigar):
            for k in range(n):
                base = "." if o == "D" else seq[read + k : read + k + 1].upper() if o in "M=X" else ""
                if base:
                    base = base if base in ".ACGT" else "N"
                    want[c, ref + k, base] = want.get((c, ref + k, base), 0) + 1
            ref += n if o in "MDN=X" else 0
            read += n if o in "MIS=X" else 0
    counted = tiles.tile_counts(df, 64)
    assert {(r.chr, r.pos, r.base): r.n for r in tiles.pileup_rows(counted, 64).collect()} == want
    consensus = {(r.chr, r.pos): (r.base, r.depth) for r in tiles.consensus_rows(counted, 64).collect()}
    best: dict = {}
    for (c, p, b), n in want.items():
        best.setdefault((c, p), []).append((-n, ".ACGTN".index(b), b, n))
    assert consensus == {k: (min(v)[2], sum(x[3] for x in v)) for k, v in best.items()}
    assert {(r.chr, r.pos, r.base): r.n for r in tiles.pileup_rows(tiles.tile_counts(df)).collect()} == want  # few bases of large tiles
    assert tiles.pileup_rows(tiles.tile_counts(df.limit(0))).collect() == []
