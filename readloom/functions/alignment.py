"""Column functions over CIGAR strings, read and reference bases.

Positions are 1-based and inclusive in `pos`; `start = pos - 1` and `end_excl = start + ref_span` are 0-based, half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIGAR operations that consume the reference, the read, or align a base of each.
ON_REFERENCE, ON_READ, ALIGNED = "M=XDN", "M=XIS", "M=X"
#: A CIGAR string: `*`, or lengths (a missing one counts as 0) each with an operation.
CIGAR = r"^(\*|([0-9]*[MIDNSHP=X])+)$"


def let(value: Column, f) -> Column:
    """f(value), with `value` computed once even where f uses it inside of lambdas."""
    return F.transform(F.array(value), f)[0]


def one_of(op: Column, ops: str) -> Column:
    return op.isin(*ops)


def parse_cigar(cigar: Column) -> Column:
    """array<struct<op string, len bigint>>; `*` is the single operation `*` of length 0, null stays null.
    A string that is no CIGAR is an error."""
    parts = F.regexp_extract_all(cigar, F.lit(r"[0-9]*[MIDNSHP=X*]"), F.lit(0))
    length = lambda p: F.coalesce(F.substring(p, F.lit(1), F.length(p) - 1).try_cast("bigint"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), length(p).cast("bigint").alias("len")))
    return F.when(cigar.rlike(CIGAR), ops).when(cigar.isNotNull(), F.raise_error(F.concat(F.lit("not a CIGAR string: "), cigar)))


def span(ops: Column, consuming: str) -> Column:
    """Sum of the lengths of the operations in `consuming`."""
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda n, o: n + F.when(one_of(o["op"], consuming), o["len"]).otherwise(F.lit(0)))


def ref_span(ops: Column) -> Column:
    """Reference bases that an alignment covers (M, =, X, D, N)."""
    return span(ops, ON_REFERENCE)


def read_span(ops: Column) -> Column:
    """Read bases that an alignment names (M, =, X, I, S)."""
    return span(ops, ON_READ)


def placed(ops: Column) -> Column:
    """array<struct<op, len, ref, read>>: each operation with the reference and read bases before it."""
    empty = F.array().cast("array<struct<op:string,len:bigint,ref:bigint,read:bigint>>")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, o: Column) -> Column:
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["ref"].alias("ref"), acc["read"].alias("read"))
        return F.struct(
            F.concat(acc["out"], F.array(here)).alias("out"),
            (acc["ref"] + F.when(one_of(o["op"], ON_REFERENCE), o["len"]).otherwise(F.lit(0))).alias("ref"),
            (acc["read"] + F.when(one_of(o["op"], ON_READ), o["len"]).otherwise(F.lit(0))).alias("read"),
        )

    return F.aggregate(ops, F.struct(empty.alias("out"), zero.alias("ref"), zero.alias("read")), step)["out"]


def _bases(seq: Column, ref: Column) -> Column:
    """Both strings as arrays of characters, for access in constant time."""
    return F.struct(F.split(seq, "").alias("seq"), F.split(ref, "").alias("ref"))


def _ref_at(b: Column, i: Column) -> Column:
    return F.coalesce(F.nullif(F.get(b["ref"], i.cast("int")), F.lit("")), F.lit("N"))


def _same(b: Column, p: Column, i: Column) -> Column:
    return _ref_at(b, p["ref"] + i) == F.get(b["seq"], (p["read"] + i).cast("int"))


def _each(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def _events(ops: Column, seq: Column, ref: Column) -> Column:
    """One string for each aligned base and deletion: `=` for a match, the reference base for a mismatch, `^` and the bases
    for a deletion. `ref` holds the reference bases from the alignment's start on."""

    def of(b: Column, p: Column) -> Column:
        base = lambda i: F.when(_same(b, p, i), F.lit("=")).otherwise(_ref_at(b, p["ref"] + i))
        gone = F.concat(F.lit("^"), F.array_join(F.slice(b["ref"], (p["ref"] + 1).cast("int"), p["len"].cast("int")), ""))
        return F.when(one_of(p["op"], ALIGNED), F.transform(_each(p["len"]), base)).when(p["op"] == "D", F.array(gone)).otherwise(F.array().cast("array<string>"))

    return let(_bases(seq, ref), lambda b: F.flatten(F.transform(placed(ops), lambda p: of(b, p))))


def md_tag(ops: Column, seq: Column, ref: Column) -> Column:
    """MD: lengths of matching runs, mismatched reference bases, `^` before deleted ones. It starts and ends with a
    digit; a run of length 0 stands between neighbouring mismatches."""

    def text(e: Column) -> Column:
        n = F.size(e).cast("bigint")
        return let(
            F.filter(_each(n), lambda i: F.get(e, i.cast("int")) != "="),
            lambda at: F.concat(
                F.array_join(
                    F.transform(at, lambda i, k: F.concat((i - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1).cast("string"), F.get(e, i.cast("int")))), ""
                ),
                (n - F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1)) - 1).cast("string"),
            ),
        )

    return let(_events(ops, seq, ref), text)


def nm_tag(ops: Column, seq: Column, ref: Column) -> Column:
    """NM: mismatches and the lengths of insertions and deletions."""
    mismatches = F.size(F.filter(_events(ops, seq, ref), lambda e: (e != "=") & ~e.startswith("^")))
    return mismatches.cast("bigint") + span(ops, "ID")


def xd_from_md(md: Column) -> Column:
    """XD: MD without zeros that stand alone between letters, with `$` where a deletion ends."""
    closed = F.regexp_replace(md, r"(\^[^0-9]*)(?=[0-9])", r"$1\$")
    return F.regexp_replace(closed, r"(?<![0-9])0(?![0-9])", "")


def normalize_cigar(cigar: Column) -> Column:
    """`=` and `X` as M, neighbouring M merged."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("run"), F.lit(False).alias("open"))
    flushed = lambda acc: F.concat(acc["out"], F.when(acc["open"], F.concat(acc["run"].cast("string"), F.lit("M"))).otherwise(F.lit("")))

    def step(acc: Column, o: Column) -> Column:
        aligned = one_of(o["op"], ALIGNED)
        text = F.concat(o["len"].cast("string"), o["op"])
        return F.struct(
            F.when(aligned, acc["out"]).otherwise(F.concat(flushed(acc), text)).alias("out"),
            F.when(aligned, acc["run"] + o["len"]).otherwise(F.lit(0).cast("bigint")).alias("run"),
            aligned.alias("open"),
        )

    return F.when(cigar == "*", cigar).otherwise(F.aggregate(parse_cigar(cigar), start, step, flushed))


def split_matches(ops: Column, seq: Column, ref: Column) -> Column:
    """CIGAR whose M, = and X operations are cut anew into runs of `=` and `X` against the reference."""

    def of(b: Column, p: Column) -> Column:
        kind = lambda i: F.when(_same(b, p, i), F.lit("=")).otherwise(F.lit("X"))
        each = F.transform(_each(p["len"]), lambda i: F.struct(kind(i).alias("op"), F.lit(1).cast("bigint").alias("len")))
        whole = F.array(F.struct(p["op"].alias("op"), p["len"].alias("len")))
        return F.when(one_of(p["op"], ALIGNED) & (p["len"] > 0), each).otherwise(whole)

    def text(e: Column) -> Column:
        op = lambda i: F.get(e, i.cast("int"))["op"]
        single = lambda i: (F.get(e, i.cast("int"))["len"] == 1) & op(i).isin("=", "X")
        begins = lambda i: (i == 0) | ~single(i) | ~F.coalesce(single(i - 1) & (op(i - 1) == op(i)), F.lit(False))
        return let(
            F.filter(_each(F.size(e)), begins),
            lambda at: F.array_join(
                F.transform(
                    at,
                    lambda i, k: F.concat(
                        F.when(single(i), F.coalesce(F.get(at, k + 1), F.size(e).cast("bigint")) - i).otherwise(F.get(e, i.cast("int"))["len"]).cast("string"), op(i)
                    ),
                ),
                "",
            ),
        )

    return let(let(_bases(seq, ref), lambda b: F.flatten(F.transform(placed(ops), lambda p: of(b, p)))), text)


def stored_bases(ops: Column, seq: Column) -> Column:
    """Read bases that the reference cannot give: those under X, I and S, in order."""
    keep = F.filter(placed(ops), lambda p: p["op"].isin("X", "I", "S"))
    return F.array_join(F.transform(keep, lambda p: F.substring(seq, (p["read"] + 1).cast("int"), p["len"].cast("int"))), "")


def rebuild_sequence(ops: Column, stored: Column, ref: Column) -> Column:
    """Inverse of split_matches and stored_bases: a read from reference bases under `=` and stored ones elsewhere."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, o: Column) -> Column:
        mine = one_of(o["op"], "XIS")
        piece = F.when(o["op"] == "=", F.substring(ref, (acc["ref"] + 1).cast("int"), o["len"].cast("int"))).when(
            mine, F.substring(stored, (acc["used"] + 1).cast("int"), o["len"].cast("int"))
        )
        return F.struct(
            F.concat(acc["out"], F.coalesce(piece, F.lit(""))).alias("out"),
            (acc["ref"] + F.when(one_of(o["op"], ON_REFERENCE), o["len"]).otherwise(F.lit(0))).alias("ref"),
            (acc["used"] + F.when(mine, o["len"]).otherwise(F.lit(0))).alias("used"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def trailing_match(seq_length: Column, ops: Column) -> Column:
    """Length of the last `=` operation when only its position is known: read bases that no operation names."""
    return seq_length - read_span(ops)


def base_lane(base: Column) -> Column:
    """0 to 5 for `.ACGT` and all else, in any case."""
    at = F.instr(F.lit(".ACGT"), F.upper(base)) - 1
    return F.when((at >= 0) & (base != ""), at).otherwise(F.lit(5)).cast("int")


def pack_bases(seq: Column) -> Column:
    """struct<bits string, n_mask string>: two bits a base (all but ACGT as A), and one for each base telling if it was N."""
    bits = F.regexp_replace(F.upper(seq), "[^ACGT]", "A")
    for base, code in (("A", "00"), ("C", "01"), ("G", "10"), ("T", "11")):
        bits = F.replace(bits, F.lit(base), F.lit(code))
    return F.struct(bits.alias("bits"), F.regexp_replace(F.regexp_replace(F.upper(seq), "[ACGT]", "0"), "[^0]", "1").alias("n_mask"))


def unpack_bases(packed: Column) -> Column:
    """Inverse of pack_bases, for sequences of A, C, G, T and N."""
    pairs = F.regexp_extract_all(packed["bits"], F.lit(".."), F.lit(0))
    base = lambda b, n: F.when(n == "1", "N").when(b == "00", "A").when(b == "01", "C").when(b == "10", "G").otherwise("T")
    return F.when(F.length(packed["n_mask"]) > 0, F.array_join(F.zip_with(pairs, F.split(packed["n_mask"], ""), base), "")).otherwise(F.lit(""))


def decode_bam_cigar(word: Column) -> Column:
    """struct<op, len> of a 32-bit BAM word: the length in the high 28 bits, the operation in the low 4."""
    return F.struct(F.substring(F.lit("MIDNSHP=X"), (word.bitwiseAND(15) + 1).cast("int"), F.lit(1)).alias("op"), F.shiftright(word, 4).cast("bigint").alias("len"))


def decode_bam_base(nibble: Column) -> Column:
    """Base of a 4-bit BAM code."""
    return F.substring(F.lit("=ACMGRSVTWYHKDBN"), (nibble + 1).cast("int"), F.lit(1))
