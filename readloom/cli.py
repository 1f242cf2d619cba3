"""Command line: ingest, query, sort, selftest, stats."""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import functions as F

from readloom.api import ReadStore
from readloom.operators import columns, stats
from readloom.session import session
from readloom.sources import bam, store, text


def memory(value: str) -> int:
    """Bytes of a size such as 512M or 2G."""
    if not (m := re.fullmatch(r"(\d+)([KMG]?)", value, re.IGNORECASE)):
        raise argparse.ArgumentTypeError(f"not a size: {value}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description="Aligned reads on Spark")
    top.add_argument("-v", "--verbose", type=int, default=0, choices=(0, 1, 2), help="log level")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="write a store of alignment files")
    ingest.add_argument("inputs", nargs="+")
    ingest.add_argument("-o", "--output", required=True)
    ingest.add_argument("-r", "--reference")
    ingest.add_argument("-l", "--lossy", type=float, default=0, help="percent of error that qualities may change by")
    ingest.add_argument("--lossy-scope", choices=("all", "first_block"), default="all", help="rows that the table of qualities comes from")
    ingest.add_argument("--codec", default="zstd")
    ingest.add_argument("-f", "--force", action="store_true", help="overwrite the output")
    query = commands.add_parser("query", help="reads of ranges, as text")
    query.add_argument("store")
    query.add_argument("range", nargs="?", default="", help="[file,]contig[:start[-end]];...")
    query.add_argument("-r", "--reference", help="the one that the store was written with")
    query.add_argument("-o", "--output", help="folder; standard output if not given")
    query.add_argument("-f", "--include", type=int, default=0)
    query.add_argument("-F", "--exclude", type=int, default=0)
    query.add_argument("-x", "--overlap", action="store_true")
    query.add_argument("-Q", "--no-quality", action="store_true")
    query.add_argument("-H", "--header", action="store_true")
    order = commands.add_parser("sort", help="alignment text in coordinate order")
    order.add_argument("inputs", nargs="+", help="several inputs are sorted each for itself")
    order.add_argument("-o", "--output", required=True)
    order.add_argument("-M", "--memory", type=memory, default=1 << 30, help="memory of the driver")
    test = commands.add_parser("selftest", help="write a store, read it back and compare it with the input")
    test.add_argument("inputs", nargs="+")
    test.add_argument("-o", "--output", required=True, help="where the store is written")
    test.add_argument("-r", "--reference")
    report = commands.add_parser("stats", help="statistics of a store")
    report.add_argument("store")
    report.add_argument("-f", "--mask", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("readloom-cli", memory=f"{max(1, getattr(args, 'memory', 4 << 30) >> 20)}m")
    spark.sparkContext.setLogLevel(("ERROR", "WARN", "INFO")[args.verbose])
    if args.command == "ingest":
        ReadStore.ingest(spark, args.inputs, args.output, args.lossy, args.force, args.reference, args.codec, args.lossy_scope)
    elif args.command == "query":
        opened = ReadStore(spark, args.store, args.reference)
        found = opened.query(args.range, args.include, args.exclude, args.overlap, args.no_quality)
        if args.output:
            header = store.read_store(spark, args.store, "header") if args.header else None
            text.write_sam(found, args.output, header, ["chr", "pos", "row_id"])
        else:
            if args.header:
                print("\n".join(line for i in range(opened.n_files()) for line in opened.header(i)))
            for row in opened.ordered(found).select(text.sam_line().alias("line")).toLocalIterator():
                print(row["line"])
    elif args.command == "selftest":
        began = time.time()
        opened = ReadStore.ingest(spark, args.inputs, args.output, overwrite=True, reference=args.reference)
        written = time.time()
        found = opened.differences(args.inputs).limit(10).collect()
        print(f"written {written - began:.1f} s, compared {time.time() - written:.1f} s: {'different' if found else 'equal'}")
        for row in found:
            print(f"{'missing' if row['missing'] else 'added'} {row['file_id']} {row['line']}")
        return int(bool(found))
    elif args.command == "sort":
        reads = header = None
        for i, source in enumerate(args.inputs):
            is_bam = text.sniff(spark, source) == "bam"
            own = (bam.read_bam if is_bam else text.read_sam)(spark, source).withColumn("file_id", F.lit(i))
            lines = (bam.read_bam_header(spark, source)[0] if is_bam else text.read_header(spark, source)).withColumn("file_id", F.lit(i))
            rank = columns.first_seen_dictionary(own, [], "chr", "row_id")
            own = columns.coordinate_order(own, rank).withColumn("unmapped", F.col("chr") == "*")
            reads, header = (own, lines) if reads is None else (reads.unionByName(own), header.unionByName(lines))
        text.write_sam(reads, args.output, header, ["unmapped", "chr_rank", "pos", "row_id"])
    else:
        flags = ReadStore(spark, args.store).flags()
        stats.filtered_count(flags, args.mask).show()
        print("file_id\tflag\tn")
        for row in flags.orderBy("file_id", "flag").toLocalIterator():
            print(f"{row['file_id']}\t{row['flag']}\t{row['n']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
