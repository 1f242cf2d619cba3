"""Operators over ordered rows that do not gather a contig in one task.

Rows are dealt to tasks by ranges of their order. What a task must know of those before it, a last row, a count or a sum, is
one small row for each task and contig, which is carried on between the tasks and joined back.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from readloom.operators.columns import BLOCK_ROWS, ESCAPE
from readloom.storage import materialize

#: Columns of a ranged frame: the task of a row, and its place over all.
PART, AT = "_part", "_at"
#: Rows, one for each task and contig, that are broadcast.
MOST_CARRIED = 1_000_000


def ranged(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """`df` in the order of its partition and order columns, with PART and AT. It is written, since ranges are sampled and two
    passes must see the same ones."""
    keys = [*partition, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(placed.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()), "ordered")


def _own(partition: list[str]) -> WindowSpec:
    return Window.partitionBy(PART, *partition).orderBy(AT)


def _carried(rows: DataFrame, partition: list[str], own: Column, carry) -> DataFrame:
    """(PART, partition..., _before): `carry` over what `own` gives of the tasks before; one row for each task and contig."""
    each = rows.groupBy(PART, *partition).agg(own.alias("_of"))
    before = Window.partitionBy(*partition).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(PART, *partition, carry("_of").over(before).alias("_before"))


def _joined(rows: DataFrame, carried: DataFrame, partition: list[str]) -> DataFrame:
    """Rows with `_before` of their task and contig; null contigs are equal."""
    keys = [PART, *partition]
    right = carried.select("_before", *(F.col(k).alias(f"_of_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & (rows[k].eqNullSafe(right[f"_of_{k}"]) if k != PART else rows[k] == right[f"_of_{k}"])
    right = F.broadcast(right) if right.count() <= MOST_CARRIED else right
    return rows.join(right, same).drop(*(f"_of_{k}" for k in keys))  # a row for each task and contig


def row_before(rows: DataFrame, partition: list[str], value: str, out: str) -> DataFrame:
    """Adds the value of the row before; null for the first of a contig."""
    last = F.last  # the last row of the nearest task before that has any
    carried = _carried(rows, partition, F.max_by(F.struct(value), AT), last)
    first = F.row_number().over(_own(partition)) == 1
    here = F.when(first, F.col("_before")[value]).otherwise(F.lag(value).over(_own(partition)))
    return _joined(rows, carried, partition).withColumn(out, here).drop("_before")


def running_sum(rows: DataFrame, partition: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of a column from a contig's first row on."""
    valued = rows.withColumn("_value", value)
    carried = _carried(valued, partition, F.sum("_value"), F.sum)
    here = F.sum("_value").over(_own(partition).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(valued, carried, partition).withColumn(out, F.coalesce("_before", F.lit(0)) + here).drop("_before", "_value")


def filled(rows: DataFrame, partition: list[str], value: str, out: str) -> DataFrame:
    """Adds the last value that is not null, from a contig's first row on."""
    carried = _carried(rows, partition, F.max_by(value, F.when(F.col(value).isNotNull(), F.col(AT))), lambda c: F.last(c, ignorenulls=True))
    here = F.last(value, ignorenulls=True).over(_own(partition).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(rows, carried, partition).withColumn(out, F.coalesce(here, F.col("_before"))).drop("_before")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, AT)


def row_numbers(df: DataFrame, partition: list[str], order: list[str], out: str = "row_no") -> DataFrame:
    """Adds the number of a row in its contig, from 0, in an order. A row's place in its task is in AT already, so rows cross one exchange."""
    rows = ranged(df, partition, order)
    each = rows.groupBy(PART, *partition).agg(F.min(AT).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(PART, *partition, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    return _plain(_joined(rows, carried, partition).withColumn(out, F.col(AT) + F.col("_before")).drop("_before"))


def assign_blocks(df: DataFrame, partition: list[str], order: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds block_id: rows of a contig, in order, `rows` to a block."""
    return row_numbers(df, partition, order, "block_id").withColumn("block_id", F.floor(F.col("block_id") / rows).cast("long"))


def _last_reached(pointers: np.ndarray, end: int) -> np.ndarray:
    """Where the chain of pointers from each place leaves the places below `end`. Pointers are doubled, so steps grow with the logarithm of a
    chain's length."""
    out = pointers.copy()
    while len(out) and out.min() < end:
        inside = out < end
        out[inside] = out[out[inside]]
    return out


def _reached(pointers: np.ndarray, first: int, end: int) -> np.ndarray:
    """Places below `end` on the chain of pointers from `first`, by doubling."""
    on, step = np.zeros(end, bool), np.append(np.minimum(pointers, end), end)
    on[first] = True
    while True:
        more = step[np.flatnonzero(on)]
        more = more[more < end]
        if on[more].all():
            if (step >= end).all():
                return on
        on[more] = True
        step = step[step]


def _stretches(rows: DataFrame, partition: list[str], columns: list[str], schema: str, of) -> DataFrame:
    """`of(key row, columns)` for the rows of each task and contig, sorted by number: pa.RecordBatch of `schema`."""
    kept = [PART, *partition, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(1 + len(partition))), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and keys[a] != key:
                    yield of(held[0], _columns(held, len(kept) - len(columns)))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield of(held[0], _columns(held, len(kept) - len(columns)))

    dealt = rows.repartition(PART, *partition).sortWithinPartitions(PART, *partition, columns[0])
    return dealt.select(*kept).mapInArrow(run, schema)


def _columns(held: list[pa.RecordBatch], first: int) -> list[np.ndarray]:
    table = pa.Table.from_batches(held)
    return [table.column(k).to_numpy() for k in range(first, table.num_columns)]


def assign_capped_blocks(df: DataFrame, partition: list[str], order: list[str], size: str, rows: int, cap: int) -> DataFrame:
    """Adds block_id: rows of a contig, in order; a block ends at `rows` rows or when its sizes, which are not negative, reach `cap`.

    Where a block ends depends on where it begins, so each row points to the row that would begin the next block after it: the nearest of
    `rows` further and the first at which the running sum has grown by `cap`, found by merging sums and what they are asked for in one
    order. A task follows the pointers inside its own stretch of rows, for all its rows at once. What is left is a chain over the tasks, from each
    row at which one of them can be entered to the next; that is followed by doubling too, in rounds as many as the logarithm of the
    tasks. So no task holds a contig and no loop runs over rows.
    """
    keys = df.select(*partition).schema
    placed = ranged(df.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")), partition, order)
    placed = running_sum(running_sum(placed, partition, F.lit(1).cast("long"), "_k"), partition, F.col("_size"), "_sum")
    placed = materialize(placed, "capped-rows")
    narrow = placed.select(PART, *partition, "_k", "_sum", "_size")
    asked = narrow.select(PART, *partition, "_k", (F.col("_sum") - F.col("_size") + cap).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_row"))
    held = narrow.select(PART, *partition, "_k", F.col("_sum").alias("_at"), F.lit(0).alias("_asks"), F.col("_k").alias("_row"))
    met = asked.unionByName(held).withColumnRenamed(PART, "_of").withColumn("_down", -F.col("_at")).withColumn("_last", -F.col("_k"))
    met = filled(ranged(met, partition, ["_down", "_asks", "_last"]), partition, "_row", "_full").where("_asks = 1")
    following = F.least(F.col("_k") + rows, F.coalesce(F.col("_full") + 1, F.col("_k") + rows)).alias("_next")
    pointers = materialize(met.select(F.col("_of").alias(PART), *partition, "_k", following), "capped-pointers")

    names = [f.name for f in keys.fields]
    of_key = lambda first, n: [first.column(1 + i).slice(0, 1).take(pa.array(np.zeros(n, np.int32))) for i in range(len(names))]
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields)

    def exits(first: pa.RecordBatch, columns: list[np.ndarray]) -> pa.RecordBatch:
        k, after = columns
        out = _last_reached(after - k[0], len(k)) + k[0]
        return pa.record_batch([*of_key(first, len(k)), pa.array(k), pa.array(out)], [*names, "_k", "_exit"])

    def begins(first: pa.RecordBatch, columns: list[np.ndarray]) -> pa.RecordBatch:
        k, after, entered = columns
        at = np.flatnonzero(entered)
        found = k[_reached(after - k[0], int(at[0]), len(k))] if len(at) else k[:0]
        return pa.record_batch([*of_key(first, len(found)), pa.array(found)], [*names, "_k"])

    edges = materialize(_stretches(pointers, partition, ["_k", "_next"], f"{shown}, _k long, _exit long", exits), "capped-exits")
    same = lambda a, b, *on: functools.reduce(operator.and_, [F.col(f"{a}.{p}").eqNullSafe(F.col(f"{b}.{p}")) for p in partition] + [F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x, y in on])
    entered = edges.select(*partition, F.col("_exit").alias("_k")).distinct()
    reach = edges.where("_k = 1").select(*partition, "_k")
    # only rows at which a task can be entered are nodes of the chain
    nodes = entered.unionByName(reach).distinct()
    jumps = materialize(edges.alias("e").join(nodes.alias("n"), same("e", "n", ("_k", "_k")), "left_semi"), "capped-jumps")
    reach, n = materialize(reach, "capped-entries"), -1
    while (now := reach.count()) != n:  # doubles what is reached
        n = now
        further = reach.alias("r").join(jumps.alias("j"), same("r", "j", ("_k", "_k"))).select(*(F.col(f"r.{p}") for p in partition), F.col("j._exit").alias("_k"))
        reach = materialize(reach.unionByName(further).distinct(), "capped-entries")
        jumps = materialize(
            jumps.alias("a").join(jumps.alias("b"), same("a", "b", ("_exit", "_k"))).select(*(F.col(f"a.{p}") for p in partition), F.col("a._k").alias("_k"), F.col("b._exit").alias("_exit")), "capped-jumps"
        )
    marked = pointers.alias("p").join(reach.withColumn("_on", F.lit(1)).alias("r"), same("p", "r", ("_k", "_k")), "left")
    marked = marked.select(F.col(f"p.{PART}").alias(PART), *(F.col(f"p.{p}") for p in partition), F.col("p._k").alias("_k"), F.col("p._next").alias("_next"), F.coalesce("_on", F.lit(0)).alias("_on"))
    starts = _stretches(marked, partition, ["_k", "_next", "_on"], f"{shown}, _k long", begins)
    told = placed.alias("p").join(starts.withColumn("_new", F.lit(1)).alias("s"), same("p", "s", ("_k", "_k")), "left")
    told = told.select("p.*", F.coalesce("_new", F.lit(0)).alias("_new"))
    numbered = running_sum(told, partition, F.col("_new").cast("long"), "block_id").withColumn("block_id", F.col("block_id") - 1)
    return _plain(numbered.drop("_k", "_sum", "_size", "_new"))


def delta(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Adds delta and escape: the difference to the value before, or 255 and the value itself if the difference is negative
    or at least ESCAPE. The first row of a contig is measured from 0."""
    rows = row_before(ranged(df, partition, order), partition, value, "_last")
    d = F.col(value) - F.coalesce("_last", F.lit(0))
    wide = (d < 0) | (d >= ESCAPE)
    out = rows.withColumn("delta", F.when(wide, F.lit(255)).otherwise(d).cast("int")).withColumn("escape", F.when(wide, F.col(value)))
    return _plain(out).drop("_last")


def delta_inverse(df: DataFrame, partition: list[str], order: list[str], out: str = "value") -> DataFrame:
    """Inverse of delta: sums of deltas since the last escape."""
    rows = running_sum(ranged(df, partition, order), partition, F.coalesce("escape", F.col("delta").cast("long")), "_sum")
    rows = rows.withColumn("_base", F.when(F.col("escape").isNotNull(), F.col("_sum") - F.col("escape")))
    rows = filled(rows, partition, "_base", "_start")
    return _plain(rows.withColumn(out, F.col("_sum") - F.coalesce("_start", F.lit(0)))).drop("_sum", "_base", "_start")


def patch_delta(patches: DataFrame, partition: list[str], position: str = "pos") -> DataFrame:
    """Adds delta and escape to positions of patches, in their order: a distance below ESCAPE, or ESCAPE and the distance less
    ESCAPE - 1. A contig's first patch is measured from 0."""
    rows = row_before(ranged(patches, partition, [position]), partition, position, "_last")
    d = F.col(position) - F.coalesce("_last", F.lit(0))
    out = rows.withColumn("delta", F.least(d, F.lit(ESCAPE)).cast("int")).withColumn("escape", F.when(d >= ESCAPE, d - ESCAPE + 1))
    return _plain(out).drop("_last")


def patch_delta_inverse(df: DataFrame, partition: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Inverse of patch_delta."""
    step = F.when(F.col("delta") == ESCAPE, F.col("escape") + ESCAPE - 1).otherwise(F.col("delta").cast("long"))
    return _plain(running_sum(ranged(df, partition, order), partition, step, out))


def unsorted_rows(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """(partition..., n_unsorted): rows whose value is below the one before."""
    rows = row_before(ranged(df, partition, order), partition, value, "_last")
    return rows.groupBy(*partition).agg(F.count_if(F.coalesce(F.col(value) < F.col("_last"), F.lit(False))).alias("n_unsorted"))


def run_ids(df: DataFrame, value: str, partition: list[str], order: list[str], out: str = "run_id") -> DataFrame:
    """Numbers runs of equal values in an order, from 0 in each partition."""
    rows = ranged(df, partition, order).withColumn("_shown", F.struct(value))
    rows = row_before(rows, partition, "_shown", "_last")
    new = F.col("_last").isNotNull() & ~F.col("_shown").eqNullSafe(F.col("_last"))
    return _plain(running_sum(rows, partition, new.cast("long"), out)).drop("_shown", "_last")


def name_deltas(df: DataFrame, tokens: str, partition: list[str], order: list[str], skip: Column | None = None) -> DataFrame:
    """(partition..., order..., slot, token): the tokens of a name that differ from the last one in their slot. Rows that `skip` chooses, such as
    those whose name their mate tells, are left out and not looked back at. A slot is dealt over tasks like a contig."""
    keys, slot = [*partition, *order], [*partition, "slot"]
    kept = df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))
    slots = ranged(kept.select(*keys, F.posexplode(tokens).alias("slot", "token")), slot, order)
    before = row_before(slots, slot, "token", "_before")
    return before.where(~F.col("token").eqNullSafe(F.col("_before"))).select(*keys, "slot", "token")


def name_deltas_inverse(rows: DataFrame, changed: DataFrame, partition: list[str], order: list[str], out: str = "tokens") -> DataFrame:
    """Inverse of name_deltas. `rows` has (partition..., order..., n_tokens) of the rows that were not skipped."""
    keys, slot = [*partition, *order], [*partition, "slot"]
    slots = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("slot"))
    met = slots.join(changed.select(*keys, "slot", F.col("token").alias("_token")), [*keys, "slot"], "left")
    told = filled(ranged(met, slot, order), slot, "_token", "token")
    listed = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "token"))).alias("_s"))
    return listed.select(*keys, F.transform("_s", lambda s: s["token"]).alias(out))
