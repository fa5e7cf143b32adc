"""Replica state from deltas: joins that may repeat, reorder or drop, and unions of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["r", "set_name", "element", "actor", "cnt"]


def delta_join(delivered_adds: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, clock) after any number of deliveries in any order: repeats change nothing."""
    adds, gone = delivered_adds.select(*STATE).distinct(), removed.select(*STATE).distinct()
    held = adds.join(gone.drop("element"), ["r", "set_name", "actor", "cnt"], "left_anti").select(*STATE)
    return held, adds.unionByName(gone).distinct()


def state_merge(*relations: DataFrame) -> DataFrame:
    """Union of keys, clocks or tombstones, without the replica."""
    out = None
    for x in relations:
        x = x.drop("r")
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def write_acks(ops: DataFrame, delivery: DataFrame, w: int = 2) -> DataFrame:
    """(op_id, n_acks, ok): whether w replicas have stored each operation."""
    acks = delivery.groupBy("op_id").agg(F.count_distinct("r").alias("n_acks"))
    out = ops.select("op_id").join(acks, "op_id", "left")
    n = F.coalesce("n_acks", F.lit(0)).cast("long")
    return out.select("op_id", n.alias("n_acks"), (n >= w).alias("ok"))


def preflist(keys: DataFrame, position, partitions: int = 64, n: int = 3) -> DataFrame:
    """Adds ``replicas``: n consecutive ring partitions from ``position`` (a number for each key)."""
    if not 0 < n <= partitions:
        raise ValueError("n must be from 1 to the number of partitions")
    start = F.pmod(position, F.lit(partitions))
    return keys.withColumn("replicas", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + i) % partitions))


def ring_position(name):
    """A stable place on the ring for a set's name: only the name counts, so a set is in one place."""
    return F.xxhash64(name)


def coordinator(preflists: DataFrame, request: Column) -> DataFrame:
    """Adds ``coordinator``, one of ``replicas`` by a hash of the request, and ``others``, the rest in order.

    The choice is as good as random, and the same when a task is run again.
    """
    pick = F.element_at("replicas", (F.pmod(request, F.size("replicas")) + 1).cast("int"))
    return preflists.withColumn("coordinator", pick).withColumn("others", F.array_remove("replicas", F.col("coordinator")))
