"""Text, BAM and FASTA sources, the store, its queries and the command line."""

from __future__ import annotations

import gzip
import io
import struct

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.api import ReadStore
from readloom.operators import columns, mates, ordered, pileup, ranges, stats
from readloom.sources import bam, store, text
from tests.reads import fold

HEADER = ["@HD\tVN:1.5\tSO:unsorted", "@SQ\tSN:c1\tLN:40", "@SQ\tSN:c2\tLN:30", "@CO\ta comment"]
LINES = [
    "p1\t99\tc2\t5\t30\t8M\t=\t15\t18\tACGTACGT\tIIIIIIII\tNM:i:0\tXB:B:c,-1,2",
    "p1\t147\tc2\t15\t30\t8M\t=\t5\t-18\tTTTTACGT\tABBBBBBB\tRG:Z:a b",
    "q\t0\tc1\t3\t255\t2S3M1I2M2D1M\t*\t0\t0\tGGACGTACG\t*",
    "q\t16\tc1\t1\t7\t4M5N4M\tc2\t9\t0\tACGTACGT\tIIIIIIII\tXA:A:!\tXF:f:1.5\tXH:H:0AFF",
    "u\t4\t*\t0\t0\t*\t*\t0\t0\tNNN\t***",
    "z\t0\tc1\t3\t1\t0M5H\t*\t0\t0\t*\t*",
]


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "a.sam"
    path.write_text("\n".join([*HEADER, *LINES]))  # no line end at the last line
    return str(path)


def test_sam_round_trip(spark, sam, tmp_path):
    reads = text.read_sam(spark, sam)
    assert [r.line for r in reads.orderBy("row_id").select(text.sam_line().alias("line")).collect()] == LINES
    header = text.read_header(spark, sam)
    assert [r.raw for r in header.orderBy("line_no").collect()] == HEADER
    assert {r["name"]: r.attrs["LN"] for r in text.header_registry(header, "SQ").collect()} == {"c1": "40", "c2": "30"}
    out = str(tmp_path / "out")
    text.write_sam(reads, out, header)
    back = spark.read.text(f"{out}/file_id=0").collect()
    assert [r.value for r in back] == [*HEADER, *LINES]


def test_no_quality_and_odd_lines(spark, tmp_path):
    path = tmp_path / "odd.sam"
    path.write_bytes(b"r\tx\tc1\t1\t1\t2M\t*\t0\t0\tAC\tII\r\n\nshort\n")
    rows = text.read_sam(spark, str(path)).orderBy("row_id").collect()
    assert [r.flag for r in rows] == [None, None] and rows[0].qual == "II" and rows[1].seq is None and rows[1].tags == []
    line = text.read_sam(spark, str(path)).where("rname = 'r'").select(text.sam_line(no_quality=True).alias("v")).first()["v"]
    assert line.endswith("AC\t@@")


def to_bam(lines, contigs):
    out = io.BytesIO()
    names = [c for c, _ in contigs]
    head = "\n".join(HEADER).encode()
    out.write(b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(contigs)))
    for name, n in contigs:
        out.write(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n))
    for line in lines:
        rname, flag, chrom, pos, mapq, cigar, pchr, ploc, tlen, seq, qual, *tags = line.split("\t")
        ops = [] if cigar == "*" else fold.ops_of(cigar)
        ref = names.index(chrom) if chrom != "*" else -1
        mate = ref if pchr == "=" else names.index(pchr) if pchr != "*" else -1
        bases = "" if seq == "*" else seq
        codes = [bam.BASES.index(b) for b in bases] + [0]
        data = struct.pack("<iiBBHHHiiii", ref, int(pos) - 1, len(rname) + 1, int(mapq), 0, len(ops), int(flag), len(bases), mate, int(ploc) - 1, int(tlen))
        data += rname.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for o, n in ops)
        data += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(bases), 2))
        data += b"\xff" * len(bases) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        for tag in tags:
            name, kind, value = tag.split(":", 2)
            data += name.encode()
            if kind == "i":
                data += b"i" + struct.pack("<i", int(value))
            elif kind == "f":
                data += b"f" + struct.pack("<f", float(value))
            elif kind == "A":
                data += b"A" + value.encode()
            elif kind == "B":
                item, *values = value.split(",")
                data += b"B" + item.encode() + struct.pack("<I", len(values)) + struct.pack(f"<{len(values)}{bam.NUMBERS[item]}", *map(int, values))
            else:
                data += kind.encode() + value.encode() + b"\0"
        out.write(struct.pack("<i", len(data)) + data)
    return gzip.compress(out.getvalue())


@pytest.fixture
def bam_file(tmp_path):
    path = tmp_path / "a.bam"
    lines = [x for x in LINES if not x.startswith("z")]
    path.write_bytes(to_bam([x.replace("\tNNN\t***", "\tNNN\tIII") for x in lines], [("c1", 40), ("c2", 30)]))
    return str(path)


def test_bam_gives_the_lines(spark, bam_file):
    got = [r.v for r in bam.read_bam(spark, bam_file).orderBy("row_id").select(text.sam_line().alias("v")).collect()]
    assert got == [x.replace("\tNNN\t***", "\tNNN\tIII") for x in LINES if not x.startswith("z")]
    header, contigs = bam.read_bam_header(spark, bam_file)
    assert [r.raw for r in header.orderBy("line_no").collect()] == HEADER
    assert [(r.chr, r.length) for r in contigs.orderBy("chr_no").collect()] == [("c1", 40), ("c2", 30)]
    assert text.sniff(spark, bam_file) == "bam"


def test_fasta(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_text(">c1 first\nACGTA\nCGTac\ng\n>c2\nTTTT\n")
    assert {r.chr: r.seq for r in text.read_fasta(spark, str(path)).collect()} == {"c1": "ACGTACGTACG", "c2": "TTTT"}
    index = {r["name"]: (r.length, r.offset, r.line_bases, r.line_width) for r in text.fasta_index(spark, str(path)).collect()}
    assert index == {"c1": (11, 10, 5, 6), "c2": (4, 28, 4, 5)}
    (tmp_path / "r.fa.fai").write_text("".join(f"{k}\t" + "\t".join(map(str, v)) + "\n" for k, v in index.items()))
    assert text.read_fasta_index(spark, f"{path}.fai").count() == 2
    (tmp_path / "c1.fa").write_text(">c1\nAA\n")
    assert text.resolve_reference(spark, path=f"{tmp_path}/", contigs=["c1", "c9", "*"]).first().bases == "AA"
    assert text.resolve_reference(spark) is None
    chunks = pileup.reference_chunks(text.read_fasta(spark, str(path)), 4)
    asks = spark.createDataFrame([("c1", 1), ("c1", 5), ("c1", 11), ("c1", 12), ("c2", 4), ("c9", 1)], "chr string, pos long")
    assert {(r.chr, r.pos): r.ref for r in pileup.reference_base(asks, chunks, 4).collect()} == {
        ("c1", 1): "A", ("c1", 5): "A", ("c1", 11): "G", ("c1", 12): "N", ("c2", 4): "T", ("c9", 1): "N",
    }


def test_fastq_names(spark, tmp_path):
    path = tmp_path / "r.fq"
    path.write_text("@a 1:N\nAC\n+\nII\n@b\nA\n+\nI\n")
    got = text.read_fastq_names(spark, str(path)).orderBy("read_no").collect()
    assert [(r.read_no, r["name"], r.comment) for r in got] == [(0, "a", "1:N"), (1, "b", None)]


def test_reference_pileup_and_patches(spark, sam):
    reads = pileup.with_spans(text.read_sam(spark, sam)).where("chr <> '*'")
    ref = {"c1": "ACGTACGTACGTACGT", "c2": "AAAAACGTACGTAATTTTACGT"}
    chunks = pileup.reference_chunks(spark.createDataFrame(list(ref.items()), "chr string, seq string"), 5)
    got = {r.row_id: r.ref for r in pileup.with_reference(reads, chunks, ["row_id"], 5).collect()}
    counts = {}
    for r in reads.collect():
        whole = ref[r.chr][r.pos - 1 : r.end_excl]
        assert got[r.row_id] == whole + "N" * (r.ref_span - len(whole))
        at = r.pos
        for op, _, base in fold.walk(r.cigar, r.seq, got[r.row_id]):
            if op in "M=XD":
                key = (r.chr, at, base if op != "D" else ".")
                counts[key] = counts.get(key, 0) + 1
            at += op in "M=XDN"
    found = pileup.pileup(pileup.aligned_bases(reads))
    assert {(r.chr, r.pos, r.base): r.n for r in found.collect()} == counts
    top = {}
    for (c, p, b), n in counts.items():
        top[c, p] = max(top.get((c, p), (0, 0, "")), (n, -".ACGTN".index(b), b))
    consensus = pileup.consensus(found)
    assert {(r.chr, r.pos): r.base for r in consensus.collect()} == {k: v[2] for k, v in top.items()}
    want = {(c, p): v[2] for (c, p), v in top.items() if v[2] != (ref[c][p - 1] if p <= len(ref[c]) else "N")}
    assert {(r.chr, r.pos): r.alt for r in pileup.patches(consensus, pileup.reference_chunks(spark.createDataFrame(list(ref.items()), "chr string, seq string"))).collect()} == want


def test_mates(spark, sam):
    reads = pileup.with_spans(text.read_sam(spark, sam)).withColumnsRenamed({"row_id": "row", "ref_span": "span"}).drop("ops", "tags")
    got = {r.row: (r.mate_state, r.mate_row, r.off) for r in mates.pair_mates(reads, ["file_id"]).collect()}
    want = {}
    rows = reads.orderBy("row").collect()
    for name in {r.rname for r in rows}:
        want |= fold.pairs([r for r in rows if r.rname == name])
    assert got == want and len(got) == 2
    coded = mates.drop_derivable(reads, mates.pair_mates(reads, ["file_id"]), ["file_id"])
    back = mates.rebuild_mates(coded, ["file_id"]).select(reads.columns)
    assert back.exceptAll(reads).count() == reads.exceptAll(back).count() == 0


def test_store(spark, sam, bam_file, tmp_path):
    path = str(tmp_path / "store")
    opened = ReadStore.ingest(spark, [sam, bam_file], path)
    assert opened.n_files() == 2 and opened.contigs() == ["c2", "c1", "*"]
    assert opened.header(1) == HEADER
    with pytest.raises(IndexError):
        opened.header(2)
    names = lambda df: sorted((r.rname, r.pos) for r in df.collect())
    assert names(opened.query("c1:3")) == [("q", 3), ("z", 3)]
    assert names(opened.query("c1:2-4", overlap=True)) == [("q", 1), ("q", 3), ("z", 3)]
    assert names(opened.query("1,c1")) == [("q", 1), ("q", 3)]
    assert names(opened.query("c2:1-9;c2:5")) == [("p1", 5), ("p1", 5), ("p1", 15)]
    assert names(opened.query("c2", flag=16)) == [("p1", 15)]
    assert opened.query(no_quality=True).where("rname = 'u'").first().qual == "@@@"
    with pytest.raises(ValueError, match="unknown contig"):
        opened.query("c7")
    with pytest.raises(ValueError, match="no file"):
        opened.query("5,c1")
    pages = list(opened.pages())
    assert sum(map(len, pages)) == 11 and all(len({(r.file_id, r.chr, r.block_id) for r in p}) == 1 for p in pages)
    rows = [row for p in pages for row in p]
    order = ["c2", "c1", "*"]
    assert [(r.file_id, order.index(r.chr), r.pos) for r in rows] == sorted((r.file_id, order.index(r.chr), r.pos) for r in rows)
    for at in (0, len(pages) // 2):
        assert [row for p in opened.pages(after=pages[at][-1]) for row in p] == [row for p in pages[at + 1 :] for row in p]
    plain = opened.count(16).first()
    assert (plain.included, plain.excluded) == (4, 7)
    order = [(r.chr, r.pos) for r in opened.ordered(opened.query("")).where("file_id = 0").collect()]
    assert order == [("c2", 5), ("c2", 15), ("c1", 1), ("c1", 3), ("c1", 3), ("*", 0)]
    assert [(r.chr) for r in store.contig_ranks(spark, path, by_header=True).orderBy("id").collect()] == ["c1", "c2"]
    plan = opened.query("c1:5-9", overlap=True)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(pos,9)" in plan


def test_store_of_contigs_that_look_like_numbers(spark, tmp_path):
    """Names stay text, more than ten blocks stay in order, and a written index answers as-of lookups."""
    names = ["01", "02", "1e5", "*"]
    rows = [f"r{i}\t0\t{c}\t{10 * i if c != '*' else 0}\t9\t4M\t*\t0\t0\tACGT\tIIII" for c in names for i in range(1, 25)]
    (tmp_path / "n.sam").write_text("\n".join(rows))
    path = str(tmp_path / "store")
    store.write_store(text.read_sam(spark, str(tmp_path / "n.sam")), path, block_rows=3)
    opened = ReadStore(spark, path)
    assert opened.contigs() == names and opened.query("01:10-20").count() == 2 and opened.query("1e5").count() == 24
    assert sorted({r.chr for r in opened.query("01;02").collect()}) == ["01", "02"]
    pages = list(opened.pages("02"))
    assert len(pages) >= 8 and [r.pos for p in pages for r in p] == [10 * i for i in range(1, 25)]
    index = store.read_store(spark, path, "blocks")
    assert [(type(r.block_id), r.chr) for r in index.where("chr = '01'").limit(1).collect()] == [(int, "01")]
    asks = spark.createDataFrame([("01", 5), ("01", 10), ("1e5", 239), ("02", 10**6)], "chr string, at long")
    of = {(r.chr, r.pos): r.block_id for r in opened.reads.collect()}
    got = {(r.chr, r.at): r.block_id for r in ranges.block_at(index, asks).collect()}
    first = {(r.chr, r.block_id): r.first_pos for r in index.collect()}
    assert got["01", 5] is None and got["01", 10] == of["01", 10] and got["02", 10**6] == of["02", 240]
    assert first["1e5", got["1e5", 239]] == max(p for (c, b), p in first.items() if c == "1e5" and p <= 239)


def test_too_many_reference_files(spark, monkeypatch):
    monkeypatch.setattr(text, "MAX_FILES", 2)
    header = spark.createDataFrame([(0, i, "SQ", {"SN": f"c{i}", "UR": f"/none/{i}.fa"}, "") for i in range(3)], "file_id int, line_no long, record_type string, attrs map<string,string>, raw string")
    with pytest.raises(ValueError, match="more than 2"):
        text.resolve_reference(spark, header)


def test_lossy_store(spark, sam, tmp_path):
    path = str(tmp_path / "lossy")
    ReadStore.ingest(spark, [sam], path, lossy_percent=30)
    assert {r.qual for r in store.read_store(spark, path).where("rname = 'q'").collect()} == {"*", "IIIIIIII"}


def test_cli(spark, sam, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    out = str(tmp_path / "s")
    assert cli.main(["ingest", sam, "-o", out]) == 0
    capsys.readouterr()
    assert cli.main(["query", out, "c2", "-H"]) == 0
    assert capsys.readouterr().out.splitlines() == [*HEADER, *LINES[:2]]
    assert cli.main(["stats", out, "-f", "16"]) == 0
    flags = capsys.readouterr().out.splitlines()
    assert [x for x in flags if x.count("\t") == 2] == ["file_id\tflag\tn", "0\t0\t2", "0\t4\t1", "0\t16\t1", "0\t99\t1", "0\t147\t1"]
    assert cli.main(["sort", sam, "-o", str(tmp_path / "sorted")]) == 0
    got = [r.value for r in spark.read.text(str(tmp_path / "sorted/file_id=0")).collect()]
    assert got == [*HEADER, LINES[0], LINES[1], LINES[3], LINES[2], LINES[5], LINES[4]]
    assert cli.memory("2G") == 2 << 30


def test_sort_of_a_binary_file_keeps_its_header(spark, bam_file, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    assert cli.main(["sort", bam_file, "-o", str(tmp_path / "sorted")]) == 0
    got = [r.value for r in spark.read.text(str(tmp_path / "sorted/file_id=0")).collect()]
    assert got[: len(HEADER)] == HEADER and len(got) > len(HEADER)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("chr2", [("chr2", 1, ranges.MAX_POS, 0)]),
        ("chr2:5", [("chr2", 5, ranges.MAX_POS, 0)]),
        ("chr2:9-5", [("chr2", 5, 9, 0)]),
        ("1,chr2:5-9", [("chr2", 5, 9, 1)]),
        ("chr1:1-5;chr2:2-3", [("chr1", 1, 5, 0), ("chr2", 2, 3, 0)]),
        ("gi|1:x-2:5-9", [("gi|1:x-2", 5, 9, 0)]),
        ("a,b:3-4", [("a,b", 3, 4, 0)]),
    ],
)
def test_range_texts(given, want):
    names = ["chr1", "chr2", "gi|1:x-2", "a,b"]
    assert [(r.chr, r.start, r.end, r.file_id) for r in ranges.parse_ranges(given, names)] == want
    assert [(r.chr, r.start, r.end, r.file_id) for r in ranges.parse_ranges(given)] == want


def test_flag_masks(spark):
    df = spark.createDataFrame([(1,), (4,), (5,)], "flag int")
    pick = lambda c: {r.flag for r in df.where(c).collect()}
    assert pick(ranges.include(F.col("flag"), 5)) == {5}
    assert pick(ranges.exclude_all(F.col("flag"), 5)) == {1, 4}
    assert pick(ranges.exclude_any(F.col("flag"), 5)) == set()


def test_capped_blocks(spark):
    rows = [(c, i, n) for c in "ab" for i, n in enumerate([5, 5, 1, 9, 2, 2, 2, 2, 50, 1])]
    df = spark.createDataFrame(rows, "chr string, pos int, size int").repartition(3)
    got = {(r.chr, r.pos): r.block_id for r in ordered.assign_capped_blocks(df, ["chr"], ["pos"], "size", 4, 10).collect()}
    for c in "ab":
        block = count = total = 0
        for i, n in enumerate([5, 5, 1, 9, 2, 2, 2, 2, 50, 1]):
            if count >= 4 or total >= 10:
                block, count, total = block + 1, 0, 0
            count, total = count + 1, total + n
            assert got[c, i] == block


def test_sorted_assertion(spark):
    df = spark.createDataFrame([(1, 5), (2, 4)], "row int, pos int")
    with pytest.raises(Exception, match="not sorted"):
        columns.assert_sorted(df.withColumn("one", F.lit(1)), "pos", ["one"], ["row"]).collect()


def test_lines_of_a_folder_follow_file_names(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3\n4\n")
    (tmp_path / "a.txt").write_text("0\n1\n2\n")
    (tmp_path / "c.txt").write_text("5")
    rows = text.numbered_lines(spark, [str(tmp_path)]).collect()
    assert sorted((r.line_no, r.value) for r in rows) == [(i, str(i)) for i in range(6)]


def test_fasta_index_of_line_ends(spark, tmp_path):
    data = b">a x\r\nACGT\r\nAC\r\n>b\r\nTTTTTT\r\n"
    (tmp_path / "r.fa").write_bytes(data)
    rows = {r.name: r for r in text.fasta_index(spark, str(tmp_path / "r.fa")).collect()}
    assert {k: (r.length, r.offset, r.line_bases, r.line_width) for k, r in rows.items()} == {"a": (6, data.index(b"ACGT"), 4, 6), "b": (6, data.index(b"TTT"), 6, 8)}


def test_selftest_and_scope(spark, sam, bam_file, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    assert cli.main(["selftest", sam, bam_file, "-o", str(tmp_path / "s")]) == 0
    assert "equal" in capsys.readouterr().out
    other = tmp_path / "b.sam"
    other.write_text("\n".join([*HEADER, LINES[0], LINES[0]]) + "\n")
    found = ReadStore(spark, str(tmp_path / "s")).differences([str(other), bam_file]).collect()
    assert sorted((r.missing, r.line) for r in found) == sorted([(True, LINES[0]), *((False, x) for x in LINES[1:])])
    rows = [(f, i, q) for f in (0, 1) for i, q in enumerate(["5" * 20, "5" * 20, "I" * 9 + "H"] * 2)]
    df = spark.createDataFrame(rows, "file_id int, row_id long, qual string")
    for scope, n in (("all", 6), ("first_block", 2)):
        table = stats.lossy_table({r["code"]: r["n"] for r in stats.quality_histogram(df.where(F.col("row_id") < n), "qual").collect()}, 33, 20)
        want = {(f, i): q.translate(table) for f, i, q in rows}
        assert {(r.file_id, r.row_id): r.qual for r in stats.quantise(df, "qual", 20, scope, 2).collect()} == want
    with pytest.raises(ValueError):
        stats.quantise(df, "qual", 20, "some")


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert text.full_path("a.sam") == str(tmp_path / "a.sam") and text.full_path("s3a://b/c") == "s3a://b/c"
    assert [text.is_s3(x) for x in ("s3://b/c", "s3a://b/c", "https://b.s3.amazonaws.com/c", "https://s3-eu-west-1.amazonaws.com/b/c", "https://x.org/s3.txt", "a")] == [True] * 4 + [False] * 2
    assert [text.is_web(x) for x in ("http://a/b", "a/http://b")] == [True, False] and text.remove_extension("a.b/c.sam") == "a.b/c"
