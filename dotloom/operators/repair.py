"""Read repair: what each replica of a quorum lacks of a merged read, or still holds without need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .read import DOT, live_flag, survivors

DOT_KEY = ["set_name", "element", "actor", "cnt"]


def read_repairs(held: DataFrame, clock: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """(replica, set_name, element, action, actor, cnt): live dots to add, dead ones to remove.

    A replica without any state (not found) gets every survivor.
    """
    live = survivors(held, clock, quorum)
    spark = held.sparkSession
    members = spark.createDataFrame([(r,) for r in quorum], "r int")
    mine = held.where(F.col("r").isin(*quorum))
    key = ["r", *DOT_KEY]
    wanted = live.crossJoin(F.broadcast(members))  # a row for each replica of the quorum
    adds = wanted.join(mine, key, "left_anti").withColumn("action", F.lit("add"))
    removes = mine.join(live, DOT_KEY, "left_anti").withColumn("action", F.lit("remove"))
    return adds.unionByName(removes).select(F.col("r").alias("replica"), "set_name", "element", "action", "actor", "cnt")


def wide_repairs(wide: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """The same on a wide log (see :mod:`dotloom.sources.oplog`): one pass, without a join or shuffle."""
    live = live_flag(quorum)
    todo = []
    for r in quorum:
        held = F.col(f"held{r}")
        action = F.when(live & ~held, "add").when(~live & held, "remove")
        todo.append(F.when(action.isNotNull(), F.struct(F.lit(r).alias("replica"), action.alias("action"))))
    each = wide.select(*DOT_KEY, F.explode(F.array_compact(F.array(*todo))).alias("x"))
    return each.select("x.replica", "set_name", "element", "x.action", "actor", "cnt")


def wide_repaired(wide: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """(r, dot): what the quorum's replicas hold once the repairs are applied."""
    todo = wide_repairs(wide, quorum).select(F.col("replica").alias("r"), *DOT_KEY, "action")
    at = F.array_compact(F.array(*[F.when(F.col(f"held{r}"), F.lit(r)) for r in quorum]))
    held = wide.select(F.explode(at).alias("r"), *DOT_KEY, F.lit("held").alias("action"))
    said = held.unionByName(todo).groupBy("r", *DOT_KEY).agg(F.max(F.col("action") == "remove").alias("gone"))
    return said.where(~F.col("gone")).drop("gone")


def apply_repairs(held: DataFrame, clock: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, clock) after the repairs: removes first, then adds, whose dots the clock has then seen."""
    r = repairs.withColumnRenamed("replica", "r")
    dead = r.where("action = 'remove'").drop("action")
    new = r.where("action = 'add'").drop("action")
    key = ["r", *DOT]
    kept = held.join(dead, key, "left_anti").select(*key).unionByName(new.select(*key)).distinct()
    return kept, clock.select(*key).unionByName(r.select(*key)).distinct()
