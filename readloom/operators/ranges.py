"""Flag filters, genomic ranges and interval joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest position; the end of a range that names none.
MAX_POS = (1 << 31) - 1


def include(flag: Column, mask: int) -> Column:
    """All bits of the mask are set."""
    return flag.bitwiseAND(mask) == mask


def exclude_all(flag: Column, mask: int) -> Column:
    """Not all bits of the mask are set: the filter of rows."""
    return flag.bitwiseAND(mask) != mask


def exclude_any(flag: Column, mask: int) -> Column:
    """No bit of the mask is set: the filter of counts."""
    return flag.bitwiseAND(mask) == 0


@dataclass(frozen=True)
class Range:
    """Positions start to end (1-based, both included) of a contig in a file."""

    chr: str
    start: int = 1
    end: int = MAX_POS
    file_id: int = 0


def parse_ranges(text: str, contigs: list[str] | None = None) -> list[Range]:
    """Ranges of `[file,]chr[:start[-end]];...`. A missing end is open, a reversed range is turned around.

    Names may hold `:`, `-` and `,`: of the readings that the text allows, one whose name is in `contigs` is taken;
    without a list, the longest name.
    """
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        readings = []
        for file_id, rest in [(0, part), *([(int(m[1]), m[2])] if (m := re.fullmatch(r"(\d+),(.+)", part)) else [])]:
            if m := re.fullmatch(r"(.+?):(\d+)(?:-(\d+))?", rest) or re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", rest):
                start, end = int(m[2]), int(m[3]) if m[3] else MAX_POS
                readings.append(Range(m[1], min(start, end), max(start, end), file_id))
            readings.append(Range(rest, file_id=file_id))
        if contigs is not None:
            known = [r for r in readings if r.chr in contigs]
            if not known:
                raise ValueError(f"unknown contig in range {part!r}")
            out.append(known[0])
        else:  # a file index is read as one, and positions as such
            out.append(next((r for r in reversed(readings) if r.end != MAX_POS or ":" in part and r.start != 1), readings[-1]))
    return out


def check_ranges(ranges: list[Range], contigs: list[str], n_files: int) -> None:
    """Errors for ranges of a file or contig that a store lacks."""
    for r in ranges:
        if not 0 <= r.file_id < n_files:
            raise ValueError(f"no file {r.file_id}")
        if r.chr not in contigs:
            raise ValueError(f"unknown contig {r.chr!r}")


def in_range(r: Range, overlap: bool = False, max_ref_span: int | None = None) -> Column:
    """Rows that start in a range; with `overlap`, also earlier ones whose end_excl reaches it.

    In overlap mode `max_ref_span`, the longest span of the contig, adds a bound that follows from the others, so that
    row groups sorted by pos can be skipped.
    """
    here = (F.col("chr") == r.chr) & (F.col("pos") <= r.end)
    if not overlap:
        return here & (F.col("pos") >= r.start)
    found = here & ((F.col("pos") >= r.start) | (F.col("end_excl") >= r.start))
    return found if max_ref_span is None else found & (F.col("pos") >= r.start - max_ref_span)


def ranges_frame(df: DataFrame, ranges: list[Range]) -> DataFrame:
    """(range_no, file_id, range_chr, range_start, range_end)."""
    rows = [(i, r.file_id, r.chr, r.start, r.end) for i, r in enumerate(ranges)]
    return df.sparkSession.createDataFrame(rows, "range_no int, file_id int, range_chr string, range_start long, range_end long")


def _files(df: DataFrame, ranges: list[Range] | None = None) -> bool:
    """Whether ranges choose files by the frame's file_id; an error for ranges of other files over a frame of one."""
    if "file_id" in df.columns:
        return True
    if ranges and any(r.file_id for r in ranges):
        raise ValueError("ranges name a file, and these rows have no file_id")
    return False


def multi_range(reads: DataFrame, ranges: DataFrame, overlap: bool = False, bin_size: int = 1 << 14) -> DataFrame:
    """Rows of each range, once for every range they are in, with range_no; of the range's file where the rows have a file_id. Ranges
    and reads meet in bins of positions, so the join has an equality; a pair is kept in one bin only, so no duplicates arise."""
    end = F.greatest(F.col("pos"), F.col("end_excl")) if overlap else F.col("pos")
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size)))
    left = reads.withColumn("bin", spread(F.col("pos"), end))
    last = reads.agg(F.max("pos")).first()[0] or 0  # an open range needs no bins past the data
    right = ranges.withColumn("top", F.least("range_end", F.lit(last))).where("range_start <= top")
    right = right.withColumn("bin", spread(F.col("range_start"), F.col("top"))).drop("top").withColumnsRenamed({"bin": "of_bin", "file_id": "of_file"})
    if not _files(reads):
        right = right.withColumn("of_file", F.when(F.col("of_file") == 0, 0).otherwise(F.raise_error(F.lit("ranges name a file, and these rows have no file_id"))))
    own = F.col("file_id") == F.col("of_file") if _files(reads) else F.col("of_file") == 0
    joined = left.join(right, own & (F.col("chr") == F.col("range_chr")) & (F.col("bin") == F.col("of_bin")))
    first = F.floor(F.greatest("pos", "range_start") / bin_size)
    meets = (F.col("pos") <= F.col("range_end")) & (end >= F.col("range_start"))
    return joined.where(meets & (F.col("bin") == first)).select(*[reads[c] for c in reads.columns], "range_no")


def any_range(reads: DataFrame, ranges: list[Range], overlap: bool = False) -> DataFrame:
    """Rows of any of the ranges, once; of the range's file where the rows have a file_id."""
    by_file = _files(reads, ranges)
    keep = F.lit(False)
    for r in ranges:
        keep = keep | (in_range(r, overlap) & (F.col("file_id") == r.file_id) if by_file else in_range(r, overlap))
    return reads.where(keep)


def blocks_of_range(index: DataFrame, r: Range) -> DataFrame:
    """Blocks of an index (chr, first_pos, last_end and, of several files, file_id) that can hold rows of a range."""
    here = (F.col("chr") == r.chr) & (F.col("first_pos") <= r.end) & (F.col("last_end") >= r.start)
    return index.where(here & (F.col("file_id") == r.file_id) if _files(index, [r]) else here)


def blocks_of_ranges(index: DataFrame, ranges: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """(range_no, file_id, chr, block_id), file_id if the index has it: blocks of an index that can hold rows of each range of a table
    (see ranges_frame). Blocks and ranges meet in bins of positions; a pair is kept in one bin only. An open range is cut at the index's last
    position."""
    by_file = _files(index)
    top = index.agg(F.max("last_end").alias("top"))  # one row
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size)))
    cut = ranges.join(F.broadcast(top)).withColumn("range_end", F.least("range_end", "top")).where("range_start <= range_end")
    left = index.withColumn("bin", spread(F.col("first_pos"), F.greatest("first_pos", "last_end")))
    right = cut.select("range_no", F.col("file_id").alias("of_file"), "range_chr", "range_start", "range_end", spread(F.col("range_start"), F.col("range_end")).alias("of_bin"))
    own = F.col("file_id") == F.col("of_file") if by_file else F.col("of_file") == 0
    met = left.join(right, own & (F.col("chr") == F.col("range_chr")) & (F.col("bin") == F.col("of_bin")))
    meets = (F.col("first_pos") <= F.col("range_end")) & (F.col("last_end") >= F.col("range_start"))
    one_bin = F.col("bin") == F.floor(F.greatest("first_pos", "range_start") / bin_size)
    return met.where(meets & one_bin).select("range_no", *(["file_id"] if by_file else []), "chr", "block_id")


def block_at(index: DataFrame, positions: DataFrame) -> DataFrame:
    """As-of lookup: for rows (chr, at) the last block of an index that starts at or before `at`, with block_id, of the
    index's own type, null if none. Both sides are dealt to tasks by ranges of one order, and a task carries its last block to those
    after it: no pairs of rows are made and no task holds a contig."""
    from readloom.operators import ordered

    kind = index.schema["block_id"].dataType
    both = positions.select("chr", "at", F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("block")).unionByName(
        index.select("chr", F.col("first_pos").alias("at"), F.lit(0).alias("asks"), F.col("block_id").alias("block"))
    )
    placed = ordered.ranged(both, ["chr"], ["at", "asks", "block"])
    return ordered.filled(placed, ["chr"], "block", "block_id").where("asks = 1").select("chr", "at", "block_id")
