"""Handoffs as a stream: what each sender has shown and handed over, kept by (sender, set, actor).

Items are rows (sender, set_name, actor, kind, low, high):

* ``clock``: a run of counters that the sender has seen
* ``key``: a dot that it hands over (low = high)
* ``end``: all is sent; low counts the dots of its clock, high the keys

Items may come twice and in any order. When the counts of the end are reached, what the sender has
seen and didn't hand over, the dots that it removed, is told as runs, and its state is cleared. State is runs,
not dots, so its size is that of the gaps.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clock
from ..sources.oplog import OpLog
from ..sources.workspace import shared_folder

ITEM = "sender string, set_name string, actor string, kind string, low long, high long"
REMOVED = "sender string, set_name string, actor string, low long, high long"
_STATE = "seen string, handed string, want_seen long, want_handed long"


def with_run(runs: list[list[int]], low: int, high: int) -> list[list[int]]:
    """Sorted, separate runs with one more, which may close gaps."""
    a = bisect_left(runs, low - 1, key=lambda r: r[1])  # the first run that ends at low - 1 or later
    b = a
    while b < len(runs) and runs[b][0] <= high + 1:
        low, high = min(low, runs[b][0]), max(high, runs[b][1])
        b += 1
    return [*runs[:a], [low, high], *runs[b:]]


def without_runs(runs: list[list[int]], gone: list[list[int]]) -> list[list[int]]:
    """What of sorted runs isn't in others."""
    out: list[list[int]] = []
    for low, high in runs:
        for a, b in gone:
            if b < low:
                continue
            if a > high:
                break
            if a > low:
                out.append([low, a - 1])
            low = b + 1
        if low <= high:
            out.append([low, high])
    return out


def counters(runs: list[list[int]]) -> int:
    return sum(high - low + 1 for low, high in runs)


def _track(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    seen, handed, want = [], [], (-1, -1)
    if state.exists:
        a, b, *want = state.get
        seen, handed = json.loads(a), json.loads(b)
    for frame in frames:
        for kind, low, high in zip(frame["kind"], frame["low"], frame["high"], strict=True):
            if kind == "clock":
                seen = with_run(seen, int(low), int(high))
            elif kind == "key":
                handed = with_run(handed, int(low), int(high))
            else:
                want = (int(low), int(high))
    if (counters(seen), counters(handed)) == tuple(want):
        if state.exists:
            state.remove()
        rows = [(*key, low, high) for low, high in without_runs(seen, handed)]
        yield pd.DataFrame(rows, columns=["sender", "set_name", "actor", "low", "high"])
    else:
        state.update((json.dumps(seen), json.dumps(handed), *want))
        yield pd.DataFrame([], columns=["sender", "set_name", "actor", "low", "high"])


def removed_stream(items: DataFrame) -> DataFrame:
    """The streaming frame of what finished senders removed."""
    return items.groupBy("sender", "set_name", "actor").applyInPandasWithState(_track, REMOVED, _STATE, "append", "NoTimeout")


def handoff_items(log: OpLog, sender: int) -> DataFrame:
    """All that a replica sends in a handoff."""
    name = F.lit(f"r{sender}")
    runs = clock.runs(log.clock_of(sender).select("set_name", "actor", "cnt"), ["set_name"])
    keys = log.held_of(sender)
    row = lambda df, kind, low, high: df.select(name.alias("sender"), "set_name", "actor", F.lit(kind).alias("kind"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    total = runs.groupBy("set_name", "actor").agg(F.sum(F.col("high") - F.col("low") + 1).alias("n_seen"))
    total = total.join(keys.groupBy("set_name", "actor").agg(F.count("*").alias("n_keys")), ["set_name", "actor"], "left")
    end = row(total, "end", F.col("n_seen"), F.coalesce("n_keys", F.lit(0)))
    return row(runs, "clock", F.col("low"), F.col("high")).unionByName(row(keys, "key", F.col("cnt"), F.col("cnt"))).unionByName(end)


def run_handoffs(log: OpLog, senders: tuple[int, ...], receiver: int, batches: int = 3) -> DataFrame:
    """(sender, set_name, actor, cnt): what the receiver tombstones, after a stream of all senders' items, mixed and repeated."""
    spark: SparkSession = log.ops.sparkSession
    source, sink, checkpoint = (shared_folder(spark, f"handoff-{x}") for x in ("source", "sink", "checkpoint"))
    items: DataFrame | None = None
    for s in senders:
        one = handoff_items(log, s)
        items = one if items is None else items.unionByName(one)
    twice = items.unionByName(items.where("low % 5 = 0"))
    twice.repartition(batches, F.xxhash64(*items.columns, F.lit(3))).write.parquet(source)
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(source)
    query = removed_stream(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    gone = spark.read.schema(REMOVED).parquet(sink)
    dots = gone.select("sender", "set_name", "actor", F.explode(F.sequence("low", "high")).alias("cnt"))
    return dots.join(log.clock_of(receiver).select("set_name", "actor", "cnt"), ["set_name", "actor", "cnt"], "left_semi").select("sender", "set_name", "actor", "cnt")
