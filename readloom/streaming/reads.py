"""Streaming forms: flag counts that grow with the input, late rows, open mates, micro-batches into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_counts(stream: DataFrame) -> DataFrame:
    """(flag, n) so far; write it in complete or update mode."""
    return stream.groupBy("flag").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(start, end, by..., n) of windows of event time; rows later than `late` behind the newest are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    grouped = timed.withWatermark(time, late).groupBy(w.alias("w"), *(by or []))
    bound = lambda side: F.col(f"w.{side}").cast("timestamp_ntz").alias(side)
    return grouped.agg(F.count("*").alias("n")).select(bound("start"), bound("end"), *(by or []), "n")


def open_mates(stream: DataFrame, time: str, within: str = "10 minutes") -> DataFrame:
    """Pairs of reads of one name, the second within a time of the first: (rname, first_row, second_row). State of reads
    whose mate did not come in time is dropped behind the watermark."""
    left = stream.withWatermark(time, within).select("rname", F.col("row").alias("first_row"), F.col(time).alias("t1"), F.col("pos").alias("p1"), F.col("ploc").alias("m1"), F.col("tlen").alias("l1"))
    right = stream.withWatermark(time, within).select(F.col("rname").alias("rname2"), F.col("row").alias("second_row"), F.col(time).alias("t2"), F.col("pos").alias("p2"), F.col("ploc").alias("m2"), F.col("tlen").alias("l2"))
    near = (F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {within}"))
    same = (F.col("rname") == F.col("rname2")) & (F.col("second_row") > F.col("first_row"))
    fits = (F.col("m1") == F.col("p2")) & (F.col("m2") == F.col("p1")) & (F.col("l1") == -F.col("l2"))
    return left.join(right, same & near & fits).select("rname", "first_row", "second_row")


def late_rows(stream: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, late): rows whose value is below the largest one before them in their group, over micro-batches.
    The state of a group is that one number."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(stream.dtypes)[group]

    def check(key, frames, state):
        top = state.get[0] if state.exists else None
        for frame in frames:
            values = frame[value]
            before = values.cummax().shift(1)
            if top is not None:
                before = before.fillna(top).clip(lower=top)
            yield pd.DataFrame({group: key[0], value: values, "late": (values < before).fillna(False)})
            top = int(values.max()) if top is None else max(top, int(values.max()))
        state.update((top,))

    return stream.groupBy(group).applyInPandasWithState(check, f"{group} {kind}, {value} long, late boolean", "top long", "append", GroupStateTimeout.NoTimeout)


def append_to_store(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Writes micro-batches to Parquet by contig, each into a folder of its own that is replaced if the batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy("chr").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def settled_bases(stream: DataFrame, place: str, reach: int) -> DataFrame:
    """(place, base, n): counts of the bases at a place of a stream of aligned bases in the order of their reads, as soon as the newest
    place is `reach` ahead of it. With the longest read's span no later read can cover the place, so its consensus
    and patches are final; what is not settled is the state. `place` counts from 1, over all contigs in their order."""
    day = 86400  # time 0 is where the watermark starts
    timed = stream.select("base", F.timestamp_seconds(F.col(place) + day).alias("at")).withWatermark("at", f"{reach} seconds")
    return timed.groupBy("at", "base").agg(F.count("*").alias("n")).select((F.unix_seconds("at") - day).alias(place), "base", "n")
