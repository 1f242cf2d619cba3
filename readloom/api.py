"""The read store as an object: open, header, statistics, range queries and pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from readloom.operators import columns, derived, ranges, stats
from readloom.sources import bam, store, text


#: More ranges than this are joined in one scan.
FEW_RANGES = 16
#: As a reference: the files that the header's @SQ lines name.
HEADER = "header"


class ReadStore:
    """A written store. Nothing is read before a result is asked for; there is nothing to close. `reference` is a FASTA file, a folder of
    `<contig>.fa` files that ends in `/`, or HEADER."""

    def __init__(self, spark: SparkSession, path: str, reference: str | None = None):
        self.spark, self.path, self.reference = spark, path, reference
        self.reads = store.read_store(spark, path)

    @classmethod
    def ingest(cls, spark: SparkSession, sources: list[str], path: str, lossy_percent: float = 0, overwrite: bool = False, reference: str | None = None, codec: str = "zstd", lossy_scope: str = "all") -> ReadStore:
        """Writes a store of alignment files, text or BAM, sorted by position. With a reference, MD, XD and NM tags that it gives
        are left out and restored by queries; how many differ from it is in the table `mismatches`."""
        reads = header = None
        for i, source in enumerate(sources):
            if text.sniff(spark, source) == "bam":
                own, (lines, _) = bam.read_bam(spark, source), bam.read_bam_header(spark, source)
            else:
                own, lines = text.read_sam(spark, source), text.read_header(spark, source)
            own, lines = own.withColumn("file_id", F.lit(i)), lines.withColumn("file_id", F.lit(i))
            reads = own if reads is None else reads.unionByName(own)
            header = lines if header is None else header.unionByName(lines)
        tagged = None
        if reference:
            names = [r["name"] for r in text.header_registry(header, "SQ").select("name").distinct().collect()] if reference.endswith("/") else None
            chunks = text.resolve_reference(spark, header, None if reference == HEADER else reference, names)
            tagged = derived.with_derived(reads, chunks, ["file_id", "row_id"])
            reads = derived.elide_derived(tagged)
        store.write_store(reads, path, header, sources, lossy_percent=lossy_percent, lossy_scope=lossy_scope, codec=codec, overwrite=overwrite)
        if tagged is not None:
            derived.mismatch_counts(tagged, ["file_id"]).write.mode("overwrite").parquet(f"{path}/mismatches")
        return cls(spark, path, reference)

    def differences(self, sources: list[str]) -> DataFrame:
        """(file_id, line, missing): lines of the source files that the store does not give back, and lines that it gives and they do not
        have, as often as that is so. Empty if the store is what was ingested, up to the order of lines."""
        given = None
        for i, source in enumerate(sources):
            own = bam.read_bam(self.spark, source) if text.sniff(self.spark, source) == "bam" else text.read_sam(self.spark, source)
            own = own.select(F.lit(i).alias("file_id"), text.sam_line().alias("line"))
            given = own if given is None else given.unionByName(own)
        held = self._with_tags(self.reads).select("file_id", text.sam_line().alias("line"))
        lost, added = given.exceptAll(held), held.exceptAll(given)
        return lost.withColumn("missing", F.lit(True)).unionByName(added.withColumn("missing", F.lit(False)))

    def set_log_level(self, level: int) -> None:
        self.spark.sparkContext.setLogLevel(("ERROR", "WARN", "INFO")[level])

    def n_files(self) -> int:
        return store.read_store(self.spark, self.path, "files").count()

    def contigs(self) -> list[str]:
        """Names of the contigs that have reads; a store has few."""
        return [r["chr"] for r in store.contig_ranks(self.spark, self.path).orderBy("id").collect()]

    def header(self, file_id: int) -> list[str]:
        if not 0 <= file_id < self.n_files():
            raise IndexError(f"no file {file_id}")
        rows = store.read_store(self.spark, self.path, "header").where(F.col("file_id") == file_id).orderBy("line_no")
        return [r["raw"] for r in rows.collect()]

    def flags(self) -> DataFrame:
        """(file_id, flag, n), from the side table: no read is scanned."""
        return store.read_store(self.spark, self.path, "flags")

    def count(self, mask: int) -> DataFrame:
        """(included, excluded) reads for a flag mask."""
        return stats.filtered_count(self.flags(), mask)

    def query(self, range: str = "", flag: int = 0, exclude: int = 0, overlap: bool = False, no_quality: bool = False) -> DataFrame:
        """Reads of one or more ranges (all, without one) that have all bits of `flag` and not all bits of `exclude`.
        Several ranges give a read once for each it is in, in their order."""
        reads = self.reads
        if range:
            contigs = self.contigs()
            found = ranges.parse_ranges(range, contigs)
            ranges.check_ranges(found, contigs, self.n_files())
            reads = self._of_many(found, overlap) if len(found) > FEW_RANGES else self._of_few(found, overlap)
        if flag:
            reads = reads.where(ranges.include(F.col("flag"), flag))
        if exclude:
            reads = reads.where(ranges.exclude_all(F.col("flag"), exclude))
        if no_quality:
            reads = reads.withColumn("qual", F.repeat(F.lit("@"), F.length("seq")))
        return self._with_tags(reads)

    def _of_few(self, found: list[ranges.Range], overlap: bool) -> DataFrame:
        """A scan for each range, of which statistics of row groups skip most."""
        spans = {(r["file_id"], str(r["chr"])): r["max_ref_span"] for r in store.read_store(self.spark, self.path, "spans").collect()}
        out = None
        for i, r in enumerate(found):
            here = (F.col("file_id") == r.file_id) & ranges.in_range(r, overlap, spans.get((r.file_id, r.chr)))
            part = self.reads.where(here).withColumn("range_no", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def _of_many(self, found: list[ranges.Range], overlap: bool) -> DataFrame:
        """One scan of the ranges' files and contigs, joined with the ranges in bins."""
        reads = self.reads.where(F.col("file_id").isin(*{r.file_id for r in found}) & F.col("chr").isin(*{r.chr for r in found}))
        return ranges.multi_range(reads, ranges.ranges_frame(reads, found), overlap)

    def _with_tags(self, reads: DataFrame) -> DataFrame:
        """Reads with the tags that the reference gives; an error for a store that lacks some, if no reference is open."""
        if "elided" not in reads.columns:
            return reads
        if not self.reference:
            raise ValueError("this store was written with a reference; open it with the same one")
        names = self.contigs() if self.reference.endswith("/") else None
        header = store.read_store(self.spark, self.path, "header")
        chunks = text.resolve_reference(self.spark, header, None if self.reference == HEADER else self.reference, names)
        keys = [*(["range_no"] if "range_no" in reads.columns else []), "file_id", "row_id"]
        made = derived.with_derived(reads.select(*keys, "chr", "pos", "cigar", "seq"), chunks, keys).select(*keys, "derived")
        return derived.restore_derived(reads.join(made, keys))

    def mismatches(self) -> DataFrame:
        """(file_id, tag, present, mismatched) of tags that the reference gives; of stores that were written with one."""
        return store.read_store(self.spark, self.path, "mismatches")

    def ordered(self, df: DataFrame, by_header: bool = False) -> DataFrame:
        """Rows in the order of contigs and positions."""
        return columns.coordinate_order(df, store.contig_ranks(self.spark, self.path, by_header))

    def pages(self, range: str = "", flag: int = 0, overlap: bool = False, after: Row | None = None) -> Iterator[list[Row]]:
        """Rows of a query, a block at a time, in the order of ranges, files, contigs and positions; only one block is on the
        driver. `after`, the last row of a page, resumes behind it, in this or a later session of the same store."""
        found = self.query(range, flag, overlap=overlap)
        rank = store.contig_ranks(self.spark, self.path).select("chr", F.col("id").alias("chr_rank"))
        found = found.join(F.broadcast(rank), "chr").select(*found.columns, "chr_rank")  # one row a contig
        keys = [*(["range_no"] if "range_no" in found.columns else []), "file_id", "chr_rank", "pos", "row_id"]
        if after is not None:
            behind = F.lit(False)
            for k in reversed(keys):
                behind = (F.col(k) > after[k]) | ((F.col(k) == after[k]) & behind)
            found = found.where(behind)
        page, last = [], None
        for row in found.orderBy(*keys).toLocalIterator(prefetchPartitions=True):
            key = (*(row[k] for k in keys[:-2]), row["block_id"])
            if page and key != last:
                yield page
                page = []
            page.append(row)
            last = key
        if page:
            yield page

    def view(self, name: str) -> None:
        """Registers the reads for SQL and other languages of the session."""
        self._with_tags(self.reads).createOrReplaceTempView(name)
