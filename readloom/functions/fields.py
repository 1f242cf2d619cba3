"""Column functions over mates, read names, qualities, tags, headers and integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits, tags kept in dictionaries, tags that hold qualities, 64-bit classes.
UNMAPPED, REVERSE = 0x4, 0x10
LIBRARY_TAGS = ("PG", "RG", "LB", "PU")
QUALITY_TAGS = ("BQ", "CQ", "E2", "OQ", "QT", "Q2", "U2")
#: Tokens of a read name at most.
MAX_TOKENS = 20

# --- flags


def has_flag(flag: Column, mask: int) -> Column:
    """All bits of `mask` are set."""
    return flag.bitwiseAND(mask) == mask


def is_mapped(flag: Column) -> Column:
    return flag.bitwiseAND(UNMAPPED) == 0


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(REVERSE) != 0


# --- mates


def tlen_state(tlen: Column, flag: Column) -> Column:
    """`ok` if exactly the reads on the reverse strand have a negative tlen; else the sign that breaks the rule."""
    return (
        F.when((tlen < 0) == is_reverse(flag), F.lit("ok")).when(tlen >= 0, F.lit("greater_than_0")).otherwise(F.lit("less_than_0"))
    )


def tlen_of_state(size: Column, state: Column, flag: Column) -> Column:
    """Inverse of tlen_state for a tlen without sign."""
    negative = F.when(state == "ok", is_reverse(flag)).otherwise(state == "less_than_0")
    return F.when(negative, -size).otherwise(size)


def mate_residual(tlen: Column, span: Column, pos: Column, mate_pos: Column) -> Column:
    """What is left of the mate's position after the guess from tlen and the read's span."""
    return pos + tlen + F.when(tlen > 0, -span).otherwise(span) - mate_pos


def mate_pos_of_residual(tlen: Column, span: Column, pos: Column, residual: Column) -> Column:
    return pos + tlen + F.when(tlen > 0, -span).otherwise(span) - residual


def mate_offset(pos: Column, mate_pos: Column, tlen: Column) -> Column:
    """Distance to the mate, null where its sign contradicts that of tlen."""
    away = mate_pos - pos
    return F.when((away == 0) | (tlen == 0) | ((away > 0) == (tlen > 0)), away)


# --- read names

_SEPARATOR = r"[\x00-/:-@\[-`]"


def _marked(name: Column) -> Column:
    """The name with a line break for the separator that an accession (three letters, then 1 to 9) lacks."""
    letters = F.substring(name, 3, 1).rlike("^[A-Za-z]$") & ~F.substring(name, 1, 3).rlike(_SEPARATOR)
    return F.when(letters & F.substring(name, 4, 1).rlike("^[1-9]$"), F.concat(F.substring(name, 1, 3), F.lit("\n"), F.substring(name, F.lit(4), F.length(name)))).otherwise(name)


def tokenize_name(name: Column) -> Column:
    """struct<tokens array<string>, separators array<string>>: a name cut at each character below `0`, between `9` and `A`
    or between `Z` and `a`, into at most MAX_TOKENS tokens; the break before an accession's number has separator \\n."""
    marked = _marked(name)
    return F.struct(
        F.split(marked, _SEPARATOR, MAX_TOKENS).alias("tokens"),
        F.slice(F.regexp_extract_all(marked, F.lit(_SEPARATOR), F.lit(0)), 1, MAX_TOKENS - 1).alias("separators"),
    )


def rebuild_name(parts: Column) -> Column:
    """Inverse of tokenize_name."""
    separators = F.transform(parts["separators"], lambda s: F.when(s == "\n", F.lit("")).otherwise(s))
    return F.array_join(F.transform(F.arrays_zip(parts["tokens"].alias("t"), separators.alias("s")), lambda p: F.concat(p["t"], F.coalesce(p["s"], F.lit("")))), "")


def is_numeric_token(token: Column) -> Column:
    """A number without sign and leading zero that fits 64 bits."""
    return token.rlike("^[1-9][0-9]*$") & token.try_cast("bigint").isNotNull()


def name_and_comment(line: Column) -> Column:
    """struct<name, comment>, cut at the first blank."""
    parts = F.split(line, " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("comment"))


# --- qualities


def forward(qual: Column, flag: Column) -> Column:
    """Qualities in the order of sequencing; its own inverse."""
    return F.when(is_reverse(flag), F.reverse(qual)).otherwise(qual)


def trim_run(qual: Column) -> Column:
    """Keeps one character of the run at the end; two if the whole string is one run. `*` becomes empty."""
    last = F.right(qual, F.lit(1))
    short = F.length(F.rtrim(qual, last)) + 1
    return F.when(qual == "*", F.lit("")).otherwise(F.substring(qual, F.lit(1), F.least(F.length(qual), F.greatest(short, F.lit(2)))))


def pad_run(qual: Column, length: Column) -> Column:
    """Inverse of trim_run: repeats the last character up to `length`."""
    return F.when(qual == "", F.lit("*")).otherwise(F.rpad(qual, length.cast("int"), F.right(qual, F.lit(1))))


def quality_offset(least: Column) -> Column:
    """33, 59 or 64: the encoding in which `least`, the smallest code, can occur; null without codes."""
    return F.when(least < 59, F.lit(33)).when(least < 64, F.lit(59)).when(least.isNotNull(), F.lit(64))


def codes(text: Column) -> Column:
    """Character codes; empty for an empty text."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def shift_quality(qual: Column, offset: Column) -> Column:
    """array<int> of code - offset + 1; a value outside of 1 to 95 is an error."""
    shifted = F.transform(codes(qual), lambda c: c - offset + 1)
    good = F.forall(shifted, lambda v: (v >= 1) & (v < 96))
    return F.when(good, shifted).when(qual.isNotNull(), F.raise_error(F.concat(F.lit("quality out of range: "), qual)))


def unshift_quality(values: Column, offset: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.char(v + offset - 1)), "")


def phred_error(code: Column, offset: int) -> Column:
    """Chance of an error that a quality code states."""
    return F.pow(F.lit(10.0), (F.lit(offset) - code) / 10.0)


# --- tags and headers


def parse_tag(text: Column) -> Column:
    """struct<tag, type, value> of `XX:T:value`; anything else is an error."""
    good = text.rlike("(?s)^[^:]{2}:.:")
    parts = F.struct(F.substring(text, 1, 2).alias("tag"), F.substring(text, 4, 1).alias("type"), F.substring(text, F.lit(6), F.length(text)).alias("value"))
    return F.when(good, parts).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a tag: "), text)))


def parse_tags(texts: Column) -> Column:
    """array<struct<pos, tag, type, value>> in the order of the line."""
    return F.transform(texts, lambda t, i: F.struct(i.alias("pos"), parse_tag(t)["tag"].alias("tag"), parse_tag(t)["type"].alias("type"), parse_tag(t)["value"].alias("value")))


def tag_text(tag: Column) -> Column:
    return F.concat_ws(":", tag["tag"], tag["type"], tag["value"])


def tag_map(tags: Column) -> Column:
    """map<tag, `T:value`>; the last of repeated tags counts."""
    last = F.filter(tags, lambda t, i: F.size(F.filter(F.slice(tags, i + 2, F.size(tags)), lambda u: u["tag"] == t["tag"])) == 0)
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["tag"], F.concat_ws(":", t["type"], t["value"]))))


def width_class(value: Column) -> Column:
    """Bytes of the narrowest signed integer that holds a value: 1, 2, 4 or 8."""
    fits = lambda bits: value.between(-(1 << bits - 1), (1 << bits - 1) - 1)
    return F.when(fits(8), 1).when(fits(16), 2).when(fits(32), 4).when(value.isNotNull(), 8)


def varint_class(value: Column) -> Column:
    """Bytes of the variable-length form of a non-negative number: one below 2**8 - 1, two below 2**16, else four, where
    each wider form needs an escape byte before it."""
    return F.when(value < 255, 1).when(value < 1 << 16, 2).otherwise(4)


def sized_class(value: Column) -> Column:
    """Bytes (1, 2, 3, 4 or 8) of the narrowest unsigned form."""
    return F.when(value < 1 << 8, 1).when(value < 1 << 16, 2).when(value < 1 << 24, 3).when(value < 1 << 32, 4).otherwise(8)


def tag_key(tag: Column, kind: Column) -> Column:
    """A tag's two characters and its type as one number of base 94."""
    digit = lambda c: F.ascii(c) - 33
    return (digit(F.substring(tag, 1, 1)) * 94 + digit(F.substring(tag, 2, 1))) * 94 + digit(kind)


def tag_of_key(key: Column) -> Column:
    char = lambda n: F.char(n + 33)
    return F.struct(
        F.concat(char(F.floor(key / 8836) % 94), char(F.floor(key / 94) % 94)).alias("tag"), char(key % 94).alias("type")
    )


def is_quality_tag(tag: Column) -> Column:
    return tag.isin(*QUALITY_TAGS)


def elide(stored: Column, derived: Column) -> Column:
    """Null where a value equals what can be derived."""
    return F.when(~stored.eqNullSafe(derived), stored)


def restore(elided: Column, derived: Column) -> Column:
    return F.coalesce(elided, derived)


def header_attributes(line: Column) -> Column:
    """struct<record_type, attrs map<string,string>> of a header line `@XX<TAB>KK:value...`; a comment's text is its attr CO."""
    fields = F.split(line, "\t")
    kind = F.substring(F.get(fields, F.lit(0)), 2, 2)
    rest = F.filter(F.slice(fields, 2, F.size(fields)), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    unique = F.filter(rest, lambda x, i: F.size(F.filter(F.slice(rest, i + 2, F.size(rest)), lambda y: F.substring(y, 1, 2) == F.substring(x, 1, 2))) == 0)
    attrs = F.map_from_entries(F.transform(unique, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x)))))
    comment = F.create_map(F.lit("CO"), F.array_join(F.slice(fields, 2, F.size(fields)), "\t"))
    return F.struct(kind.alias("record_type"), F.when(kind == "CO", comment).otherwise(attrs).alias("attrs"))


def closed_overlap(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Closed intervals [a, b] and [x, y] share a point."""
    return F.least(b, y) >= F.greatest(a, x)


def float_text(value: Column) -> Column:
    """A float as `%g` of C writes it: six digits, no zeros at their end, an exponent of at least two digits below -4 and from 6 on."""
    x = value.cast("double")
    shown = F.format_string("%.5e", F.abs(x))
    digits = F.rtrim(F.replace(F.substring_index(shown, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
    power = F.substring_index(shown, "e", -1).try_cast("int")
    points = lambda d, n: F.concat(F.substring(d, F.lit(1), n), F.when(F.length(d) > n, F.concat(F.lit("."), F.substring(d, n + 1, F.length(d)))).otherwise(F.lit("")))
    far = F.concat(points(digits, F.lit(1)), F.lit("e"), F.substring_index(shown, "e", -1))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = points(F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0")), power + 1)
    plain = F.when(x == 0, "0").when((power < -4) | (power >= 6), far).when(power < 0, small).otherwise(large)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == inf, F.concat(sign, F.lit("inf"))).when(x.isNotNull(), F.concat(sign, plain))
