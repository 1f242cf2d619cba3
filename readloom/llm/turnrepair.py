"""Conversation structure repair: window flags of faults, and a fold over a conversation's sorted turns that carries the cheapest edits
to each of four states."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import materialize
from readloom.operators import ordered

#: What separates words, and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Roles may follow one another so.
LEGAL = ("su", "ua", "au")
#: What edits cost; an undeleted truncated turn costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by the roles so far: none, a system turn, up to a user's, up to an assistant's. The first and the last may end a conversation.
STATES = ("e", "s", "u", "a")
#: More than any edits cost.
NEVER = 1 << 60
#: Conversations of more turns are folded in segments of so many.
LONG = 1024
#: Long conversations up to this number are broadcast by id.
MANY_LONG = 100_000

State = dict[str, Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _state(cost: Column | int, audit: Column | str) -> Column:
    return F.struct((F.lit(cost) if isinstance(cost, int) else cost).cast("bigint").alias("cost"), (F.lit(audit) if isinstance(audit, str) else audit).alias("audit"))


def _add(state: Column, cost: Column | int, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _never(allowed: Column, state: Column) -> Column:
    return F.when(allowed, state).otherwise(_state(NEVER, ""))


def _states(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _closed(n: Column) -> Column:
    """States after any inserts."""
    into = lambda x: _add(x, INSERT, "I")
    u = F.least(n["u"], into(n["e"]), into(n["s"]), into(n["a"]))
    return _let(u, lambda user: _states(n["e"], n["s"], user, F.least(n["a"], into(user))))


def _step(acc: Column, turn: Column) -> Column:
    """States after a turn's cheapest edits and any inserts behind it."""
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    stays = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    gone = lambda x: _add(x, DELETE, "D")

    def into(before: Column, role: str) -> Column:
        kept = turn["initial"] == role
        made = F.when(kept, _add(before, extra, "K")).otherwise(_add(before, extra + REROLE, "R"))
        return _never(stays, made)

    system = _never(stays & (turn["initial"] == "s"), _add(acc["e"], extra, "K"))
    user = into(F.least(acc["e"], acc["s"], acc["a"]), "u")
    raw = _states(gone(acc["e"]), F.least(gone(acc["s"]), system), F.least(gone(acc["u"]), user), F.least(gone(acc["a"]), into(acc["u"], "a")))
    return _let(raw, _closed)


def fold(turns: Column, start: Column) -> Column:
    """The four states after sorted turns, struct<initial, fault, ...>: for each the least (cost, audit) of all edits. Of two audits of equal cost
    over the same turns none is the beginning of the other, so the least of the beginnings stays the least."""
    return F.aggregate(turns, start, _step)


def _begin() -> Column:
    """No turns yet: nothing, or inserts."""
    return _states(_state(0, ""), _state(NEVER, ""), _state(INSERT, "I"), _state(2 * INSERT, "II"))


def _only(state: str) -> Column:
    return _states(*(_state(0 if x == state else NEVER, "") for x in STATES))


def repaired(turns: Column, audit: Column, last: Column) -> Column:
    """array<struct<role, text>> of turns after the edits of an audit; `last` is the state before."""
    other = lambda was: F.when(was == "u", "assistant").otherwise("user")
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    start = F.struct(F.lit(0).alias("i"), last.alias("last"), empty.alias("out"))

    def edit(acc: Column, letter: Column) -> Column:
        turn = F.get(turns, acc["i"])
        role = F.when(letter == "K", turn["role"]).otherwise(other(acc["last"]))
        text = F.when(letter == "I", "").otherwise(turn["text"])
        kept = F.struct(
            (acc["i"] + F.when(letter == "I", 0).otherwise(1)).alias("i"),
            F.when(letter == "K", turn["initial"]).otherwise(F.substring(role, 1, 1)).alias("last"),
            F.concat(acc["out"], F.array(line(role, text))).alias("out"),
        )
        dropped = F.struct((acc["i"] + 1).alias("i"), acc["last"].alias("last"), acc["out"].alias("out"))
        return F.when(letter == "D", dropped).otherwise(kept)

    return F.aggregate(F.when(audit == "", F.array().cast("array<string>")).otherwise(F.split(audit, "")), start, edit, lambda acc: acc["out"])


def _lines(out: Column) -> Column:
    return F.array_join(F.transform(out, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after reproducible damage by crc32 of `conv_id:turn`: of twenty kinds 0 marks a row as
    gone, 1 empties its text, 2 takes its stops, 3 repeats it, 4 makes it the user's. Null roles, texts and, in the checksum, ids and
    numbers are one space; a null conv_id is a conversation."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(known("text"), "".join(STOPS), "")).otherwise(known("text"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_kind", kind)
    copies = F.explode(F.array_repeat((F.col("_kind") == 0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("_kind") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), copies.alias("gone"))


def _known(turns: DataFrame) -> DataFrame:
    """Turns with initial, bare blankness and a digest that orders turns of one number."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    return turns.select(
        "conv_id", "turn", "role", "text", "gone",
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*STOPS)).alias("open"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )


def _fault() -> Column:
    return F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")


def _counts() -> list[Column]:
    bad = ~F.concat("initial_before", "initial").isin(*LEGAL)
    each = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    return [*each, F.count_if(F.coalesce(bad, F.lit(False))).alias("illegal")]


def _turn(*more: str) -> Column:
    return F.struct(*more, "initial", "fault", "role", "text")


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded length: one exchange by conversation, which windows and the grouping share."""
    rows = rows.repartition("conv_id")
    w = Window.partitionBy("conv_id", "gone").orderBy("turn", "role", "digest")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("initial_before", F.lag("initial").over(w))
    seen = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("n")
    rows = rows.withColumn("again", F.row_number().over(seen) > 1).withColumn("fault", F.when(~F.col("gone"), _fault()))
    here = lambda c: F.when(~F.col("gone"), c)
    number = here(F.col("turn"))
    gaps = F.coalesce(F.max(number) - F.min(number) + 1 - F.size(F.collect_set(number)), F.lit(0)).cast("long")
    rows = rows.withColumn("initial_before", here(F.col("initial_before")))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(here(_turn("n")))).alias("turns"), gaps.alias("gaps"), *_counts())
    ended = each.withColumn("_end", fold(F.col("turns"), _begin())).withColumn("_best", F.least(F.col("_end.e"), F.col("_end.a")))
    named = ended.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"))
    done = named.withColumn("repaired", repaired(F.col("turns"), F.col("audit"), F.lit("e")))
    return done.drop("turns").withColumn("repaired_sha256", F.sha2(_lines(F.col("repaired")).cast("binary"), 256))


def _flagged(rows: DataFrame, size: int) -> DataFrame:
    """Turns of long conversations with segment, n, fault and initial_before. Ranges of the order are dealt to tasks, and what a
    task must know of those before is a row for each task and conversation; a text that one conversation repeats very often is told first in each
    task, then between tasks."""
    part = ["conv_id"]
    placed = ordered.ranged(rows.where(~F.col("gone")), part, ["turn", "role", "digest"])
    placed = ordered.running_sum(placed, part, F.lit(1).cast("long"), "n")
    placed = ordered.row_before(placed, part, "initial", "initial_before")
    own = Window.partitionBy("conv_id", "role", "digest", ordered.PART).orderBy(ordered.AT)
    told = placed.withColumn("_nth", F.row_number().over(own))
    across = Window.partitionBy("conv_id", "role", "digest").orderBy(ordered.PART)
    first = told.where("_nth = 1").withColumn("again", F.row_number().over(across) > 1)
    flagged = first.unionByName(told.where("_nth > 1").withColumn("again", F.lit(True)))
    return flagged.withColumn("fault", _fault()).withColumn("segment", F.floor((F.col("n") - 1) / size)).drop("_nth", ordered.PART, ordered.AT)


def _long(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired segments of conversations of any length: a segment is folded from each of the four states, and what
    that costs is chained over the segments."""
    flagged = materialize(_flagged(rows, size), "long-turns")
    grouped = flagged.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(_turn("n"))).alias("turns"))
    grouped = materialize(grouped.withColumn("ways", F.struct(*(fold(F.col("turns"), _only(x)).alias(x) for x in STATES))), "long-segments")
    chain = "struct<cost:bigint,audit:string,cuts:array<struct<start:string,audit:string>>>"
    begin = _begin()
    carried = lambda s: F.struct(s["cost"].alias("cost"), s["audit"].alias("audit"), F.array().cast("array<struct<start:string,audit:string>>").alias("cuts"))

    def through(acc: Column, segment: Column) -> Column:
        def way(x: str, y: str) -> Column:
            step = segment["ways"][x][y]
            cut = F.array(F.struct(F.lit(x).alias("start"), step["audit"].alias("audit")))
            found = F.struct((acc[x]["cost"] + step["cost"]).alias("cost"), F.concat(acc[x]["audit"], step["audit"]).alias("audit"), F.concat(acc[x]["cuts"], cut).alias("cuts"))
            lost = F.struct(F.lit(NEVER).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<struct<start:string,audit:string>>").alias("cuts"))
            return F.when(acc[x]["cost"] + step["cost"] < NEVER, found).otherwise(lost)

        return F.struct(*(F.array_min(F.array(*(way(x, y) for x in STATES))).cast(chain).alias(y) for y in STATES))

    chained = grouped.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "ways"))).alias("segments"))
    started = F.struct(*(carried(begin[x]).cast(chain).alias(x) for x in STATES))
    ended = chained.select("conv_id", F.aggregate("segments", started, through).alias("_end")).select("conv_id", F.least("_end.e", "_end.a").alias("_best"))
    best = materialize(ended.select("conv_id", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"), F.col("_best.cuts").alias("cuts")), "long-audits")
    # what inserts before the first turn are is in the first state, not in a segment
    lead = F.expr("length(audit) - aggregate(cuts, 0, (n, c) -> n + length(c.audit))")
    cuts = best.select("conv_id", F.substring("audit", F.lit(1), lead).alias("lead"), F.posexplode("cuts").alias("segment", "cut"))
    joined = grouped.select(F.col("conv_id").alias("_id"), F.col("segment").alias("_segment"), "turns").join(cuts, F.col("_id").eqNullSafe(F.col("conv_id")) & (F.col("_segment") == F.col("segment")))
    first = F.col("segment") == 0
    pieces = joined.select(
        "conv_id", F.col("segment").cast("long").alias("segment"),
        repaired(F.col("turns"), F.when(first, F.concat("lead", "cut.audit")).otherwise(F.col("cut.audit")), F.when(first, "e").otherwise(F.col("cut.start"))).alias("repaired"),
    )
    pieces = materialize(pieces, "long-repaired")
    counted = flagged.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *_counts())
    hashes = _hashes(pieces.where(F.size("repaired") > 0))
    same = lambda other: F.col("conv_id").eqNullSafe(other["_id"])
    counted, hashes = counted.withColumnRenamed("conv_id", "_id"), hashes.withColumnRenamed("conv_id", "_id")
    summary = best.drop("cuts").join(counted, same(counted)).drop("_id")
    summary = summary.join(hashes, same(hashes), "left").drop("_id")
    summary = summary.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256))).withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))
    return summary, pieces


def _hashes(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): a conversation's segments pass through one digest in their order, a segment in memory at a time."""
    kind = dict(pieces.dtypes)["conv_id"]
    keyed = pieces.select("conv_id", "segment", _lines(F.col("repaired")).alias("lines"))
    keyed = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "lines")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in rows:
            for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and held[0] == key:
                    held[1].update(b"\n" + lines.encode())
                    continue
                if held is not None:
                    yield pa.record_batch([pa.array([held[0]], batch.schema.field(0).type), pa.array([held[1].hexdigest()])], ["conv_id", "repaired_sha256"])
                held = key, hashlib.sha256(lines.encode())
                kind_of = batch.schema.field(0).type
        if held is not None:
            yield pa.record_batch([pa.array([held[0]], kind_of), pa.array([held[1].hexdigest()])], ["conv_id", "repaired_sha256"])

    return keyed.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


@dataclass(frozen=True)
class Repairs:
    """A row for each conversation, and its turns after the edits: (conv_id, segment, n, role, text), in the order of segment and n."""

    summary: DataFrame
    turns: DataFrame


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_conversations(turns: DataFrame, long: int = LONG) -> Repairs:
    """The cheapest edits that make each conversation an optional system turn and then users and assistants in turn, ending with an assistant.

    `turns` is (conv_id, turn, role, text) and, if some rows only tell that there is a conversation, gone. Turns are taken by number, null
    first; those of one number by role and a digest of the text. Null roles and texts are empty; a null conv_id is a conversation; equal rows are
    duplicates. A turn whose role is no system's, user's or assistant's initial is given a role or deleted. Edits and costs are
    at the top of the module; of edits of equal cost those with the least letters in order are taken. A conversation without rows has an
    empty audit. Other columns are left out; an empty table gives no rows.

    Conversations of more than `long` turns are flagged over ranges of their order and folded in segments, so none is gathered in one task;
    only their digests pass one task each, a segment at a time.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = _known(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), gone.alias("gone")))
    sizes = rows.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("size")).where(F.col("size") > long)
    ids = materialize(sizes.select(F.col("conv_id").alias("_id")), "long-conversations")
    n = ids.count()
    listed = lambda out: out.select("conv_id", F.col("segment").cast("long").alias("segment"), F.posexplode("repaired").alias("n", "t")).select("conv_id", "segment", "n", "t.role", "t.text")
    if not n:
        short = _short(rows)
        return Repairs(short.select(COLUMNS), listed(short.withColumn("segment", F.lit(0))))
    ids = F.broadcast(ids) if n <= MANY_LONG else ids
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    short = _short(rows.join(ids, same, "left_anti"))
    summary, pieces = _long(rows.join(ids, same, "left_semi"), long)
    return Repairs(short.select(COLUMNS).unionByName(summary.select(COLUMNS)), listed(short.withColumn("segment", F.lit(0))).unionByName(listed(pieces)))
