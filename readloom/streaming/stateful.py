"""Streams with keyed state and timers: open mates by read name, and the part of a pileup that later reads can still reach."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readloom.operators import tiles
from readloom.operators.mates import FIELDS
from readloom.operators.pileup import CHUNK

#: Seconds that a place is shifted by: watermarks begin at time 0.
SHIFT = 86_400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs, if the session has none that will do."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKS)


#: Columns of a read that the fold looks at. `leads`: it can be a candidate; `follows`: it can match one.
_FOLDED = ("row", "pos", "span", "ploc", "tlen", "leads", "follows", "at")


class _Mates(StatefulProcessor):
    """The candidates of the names of a bucket: one stays while reads of its name match it, and one that does not takes its place. A read that
    comes more than `keep` milliseconds of event time after the last of its name does not meet the candidate, in whatever batch, so what is older
    than the watermark is left out when the bucket is next written, and a timer forgets the rest. State is one value a bucket, which crosses to
    Python once a batch, not once a name."""

    def __init__(self, keys: list[str], keep: int):
        self.keys, self.keep = keys, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "candidates binary, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names: dict[tuple, tuple] = {}
        timer = None
        if self.held.exists():
            data, timer = self.held.get()
            names = pickle.loads(bytes(data))
        batch = pd.concat(list(rows), ignore_index=True).sort_values("row", kind="stable")
        whose = zip(*(batch[k].tolist() for k in self.keys), strict=True)
        found: list[tuple] = []
        for name, row, pos, span, ploc, tlen, leads, follows, at in zip(whose, *(batch[f].tolist() for f in _FOLDED), strict=True):
            first = names.get(name)
            until = at + self.keep
            if first is not None:
                f_row, f_pos, f_span, f_ploc, f_tlen, f_leads, f_until = first
                off = pos + f_span - f_pos - f_tlen
                until = max(until, f_until)
                if f_leads and follows and at <= f_until and tlen == -f_tlen and pos == f_ploc and ploc == f_pos and 0 <= off <= 1:
                    found.append((*name[:-1], row, f_row, off))
                    names[name] = (*first[:-1], until)
                    continue
            names[name] = (row, pos, span, ploc, tlen, leads, until)
        watermark = timerValues.getCurrentWatermarkInMs()
        names = {k: v for k, v in names.items() if v[-1] >= watermark}
        if timer is not None:
            self.handle.deleteTimer(timer)
        if names:
            timer = max(v[-1] for v in names.values()) + 1
            self.held.update((pickle.dumps(names, pickle.HIGHEST_PROTOCOL), timer))
            self.handle.registerTimer(timer)
        else:
            self.held.clear()
        if found:
            yield pd.DataFrame(found, columns=[*self.keys[:-1], "row", "mate", "off"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def pending_mates(stream: DataFrame, partition: list[str], time: str, keep: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """(partition..., row, mate, off): each read that matches the candidate of its name, by the same fold as mates.pair_mates, as the
    rows of a name come, batch by batch, in the order of `row`. State is one read a name, kept in so many buckets of names, each one value; a
    bucket's rows of a batch are held at a time, and its value is written anew in batches that have any. The number of buckets cannot change
    while a stream goes on. A read that comes more than `keep` of event time after the last of its name does not meet it. mates.both_sides
    gives the states of both reads of a pair."""
    keyed_state(stream.sparkSession)
    milliseconds = int(stream.sparkSession.sql(f"SELECT cast(interval {keep} AS interval day to second) AS i").first()["i"].total_seconds() * 1000)
    kinds = dict(stream.dtypes)
    # numbers cross to Python without nulls: what a null forbids is told by flags; names and their parts cross as text
    given = {f: F.col(f).cast("string" if f in ("chr", "pchr") else "long") for f in FIELDS}
    lacks = lambda *names: F.greatest(*(given[f].isNull() for f in names))
    same = F.coalesce((given["pchr"] == "=") | (given["pchr"] == given["chr"]), F.lit(False))
    keys = [f"key{i}" for i in range(len(partition) + 1)]
    at = F.col(time).cast("timestamp")
    timed = stream.select(
        *(F.col(p).cast("string").alias(k) for p, k in zip([*partition, "rname"], keys, strict=True)),
        given["row"].alias("row"),
        *(F.coalesce(given[f], F.lit(0)).alias(f) for f in ("pos", "span", "ploc", "tlen")),
        (same & ~lacks("row", "pos", "span", "ploc", "tlen") & (F.coalesce(given["tlen"], F.lit(-1)) >= 0)).alias("leads"),
        (~lacks("pos", "ploc", "tlen")).alias("follows"),
        F.unix_millis(at).alias("at"),
        at.alias("t"),
        F.pmod(F.xxhash64(*partition, "rname"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    schema = ", ".join([*(f"{k} string" for k in keys[:-1]), "row long, mate long, off long"])
    pairs = timed.withWatermark("t", "0 seconds").groupBy("bucket").transformWithStateInPandas(_Mates(keys, milliseconds), schema, "Append", "EventTime")
    return pairs.select(*(F.col(k).cast(kinds[p]).alias(p) for p, k in zip(partition, keys[:-1], strict=True)), "row", "mate", "off")


class _Tiles(StatefulProcessor):
    """Counts of a tile, until a timer tells that no later read reaches it."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "counts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, settles = None, 0
        for r in rows:
            own = tiles.unpack(bytes(r.counts), self.chunk)
            total, settles = own if total is None else total + own, r.settles
        if self.counts.exists():
            total = total + tiles.unpack(bytes(self.counts.get()[0]), self.chunk)
        else:
            self.handle.registerTimer(settles * 1000)
        self.counts.update((tiles.pack(np.ascontiguousarray(total).reshape(-1)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.counts.exists():
            yield Row("chr", "chunk", "counts")(key[0], key[1], bytes(self.counts.get()[0]))
            self.counts.clear()

    def close(self) -> None:
        pass


def settled_tiles(stream: DataFrame, place: str, reach: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(chr, chunk, counts): tiles of the pileup of a stream of reads (chr, pos, cigar, seq) in coordinate order, each once, when the
    stream is past it. `place` numbers positions over all contigs in their order, from 1, and grows by as much as pos within a contig; a
    tile is settled when a read begins `reach` places behind its end. Its consensus and patches are then final: tiles.consensus_rows and
    tiles.patch_rows take the stream that this gives. Tasks count the reads of a batch by tile before they are shuffled; state is one
    array for each tile that is not settled, so a contig is spread over as many tasks as it has open tiles."""
    keyed_state(stream.sparkSession)
    timed = stream.withColumn("_t", F.timestamp_seconds(F.col(place) + SHIFT)).withWatermark("_t", "0 seconds")
    # where the contig begins, in places: what a tile's end is measured from
    shifted = timed.withColumn("_zero", F.col(place) - F.col("pos"))
    partial = tiles.partial_counts(shifted, chunk, carry="_zero")
    settles = F.col("carried") + (F.col("chunk") + 1) * chunk + 1 + reach + SHIFT
    asked = partial.select("chr", "chunk", "counts", settles.cast("long").alias("settles"))
    return asked.groupBy("chr", "chunk").transformWithState(_Tiles(chunk), "chr string, chunk long, counts binary", "Append", "EventTime")
