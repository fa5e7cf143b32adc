"""Context dictionaries: actors as small numbers, and dots coded with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codec import be32


def dictionary(clock: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, actor, id): actors in order, from 1, in each clock."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("actor"))
    return clock.select(*keys, "actor").distinct().withColumn("id", rank.cast("int"))


def grow(known: DataFrame, dots: DataFrame, keys: list[str]) -> DataFrame:
    """The dictionary with actors that only the dots have, numbered after the known ones in order."""
    new = dots.select(*keys, "actor").distinct().join(known, [*keys, "actor"], "left_anti")
    last = known.groupBy(*keys).agg(F.max("id").alias("last"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("actor"))
    added = new.withColumn("k", rank).join(last, keys, "left").select(*keys, "actor", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("int").alias("id"))
    return known.unionByName(added)


def shortest_unsigned(n):
    """The fewest big-endian bytes that hold a number; zero takes one."""
    h = F.hex(n.cast("long"))
    return F.unhex(F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h))


def encode(dots: DataFrame, known: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, ctx): per group the dots as length, id and counter, end to end, in order of (id, counter).

    The dictionary has a row per actor of a clock, so the join is on few, small keys.
    """
    one = F.concat(be32(F.col("id")), shortest_unsigned(F.col("cnt")))
    coded = dots.join(known, [*keys, "actor"]).select(*group, F.struct("id", "cnt", F.concat(be32(F.octet_length(one)), one).alias("bin")).alias("d"))
    listed = coded.groupBy(*group).agg(F.array_sort(F.collect_list("d")).alias("d"))
    whole = F.unhex(F.array_join(F.transform("d", lambda d: F.hex(d["bin"])), ""))
    return listed.select(*group, whole.alias("ctx"))


def decode(coded: DataFrame, known: DataFrame, keys: list[str], column: str = "ctx") -> DataFrame:
    """The dots of coded contexts again: the other columns, actor, cnt."""
    digits = F.hex(column)
    start = F.struct(digits.alias("rest"), F.array().cast("array<struct<id:int,cnt:bigint>>").alias("dots"))
    number = lambda h: F.conv(h, 16, 10).cast("long")

    def step(acc, _):
        size = (number(F.substring(acc["rest"], 1, 8)) * 2).cast("int")
        body = F.substring(acc["rest"], F.lit(9), size)
        dot = F.struct(number(F.substring(body, 1, 8)).cast("int").alias("id"), number(F.substring(body, F.lit(9), size - 8)).alias("cnt"))
        more = F.struct(F.substring(acc["rest"], size + 9, F.length(acc["rest"])).alias("rest"), F.concat(acc["dots"], F.array(dot)).alias("dots"))
        return F.when(F.length(acc["rest"]) > 0, more).otherwise(acc)

    # A dot takes at least nine bytes, which bounds the steps.
    turns = F.sequence(F.lit(0), F.floor(F.octet_length(column) / 9).cast("int"))
    rest = [c for c in coded.columns if c != column]
    dots = coded.select(*rest, F.explode(F.aggregate(turns, start, step)["dots"]).alias("d")).select(*rest, "d.id", "d.cnt")
    return dots.join(known, [*keys, "id"]).select(*rest, "actor", "cnt")
