"""Clock algebra. A clock is a set of dots (keys..., actor, cnt), or packed as base and cloud.

``keys`` names the columns that tell clocks apart (a set, a replica). Clocks of any size are rows of
runs (keys, actor, low, high) of neighbouring counters, made in spans of counters, so that no task holds
an actor. Packed clocks have one row per (keys, actor): base is the end of the run 1, 2, 3, ...,
cloud the sorted dots beyond a gap, an array; they are for clocks whose clouds are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(*clocks: DataFrame) -> DataFrame:
    """Union of dots."""
    out = clocks[0]
    for c in clocks[1:]:
        out = out.unionByName(c)
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def complement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dots of a that b hasn't."""
    return a.join(b.select(a.columns), a.columns, "left_anti")


subtract = complement


def seen(dots: DataFrame, clock: DataFrame, on: list[str]) -> DataFrame:
    return dots.join(clock.select(on), on, "left_semi")


def unseen(dots: DataFrame, clock: DataFrame, on: list[str]) -> DataFrame:
    return dots.join(clock.select(on), on, "left_anti")


#: Counters that one task puts in order.
SPAN = 1 << 16


def runs(clock: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """(keys, actor, low, high): the runs of neighbouring counters.

    Counters less their rank are the same along a run, inside a span. Only runs that touch the end of a
    span, two a span at most, are looked at again to be joined with their neighbours.
    """
    dots = clock.select(*keys, "actor", "cnt").distinct().withColumn("span", F.floor(F.col("cnt") / span))
    rank = F.row_number().over(Window.partitionBy(*keys, "actor", "span").orderBy("cnt"))
    inner = dots.withColumn("run", F.col("cnt") - rank).groupBy(*keys, "actor", "span", "run").agg(F.min("cnt").alias("low"), F.max("cnt").alias("high"))
    touches = (F.col("low") == F.col("span") * span) | (F.col("high") == (F.col("span") + 1) * span - 1)
    order = Window.partitionBy(*keys, "actor").orderBy("low")
    fresh = F.when(F.col("low") == F.lag("high").over(order) + 1, 0).otherwise(1)
    edge = inner.where(touches).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    joined = edge.groupBy(*keys, "actor", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return inner.where(~touches).select(*keys, "actor", "low", "high").unionByName(joined.select(*keys, "actor", "low", "high"))


def bases(clock: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """(keys, actor, base): how far each actor's counters have no gap; 0 if the first is missing."""
    return runs(clock, keys, span).groupBy(*keys, "actor").agg(F.coalesce(F.max(F.when(F.col("low") == 1, F.col("high"))), F.lit(0)).cast("long").alias("base"))


def compress(clock: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """Packed form: (keys, actor, base, cloud)."""
    beyond = F.collect_list(F.when(F.col("low") != 1, F.struct("low", "high")))
    parts = runs(clock, keys, span).groupBy(*keys, "actor").agg(F.max(F.when(F.col("low") == 1, F.col("high"))).alias("base"), F.array_sort(beyond).alias("gaps"))
    cloud = F.flatten(F.transform("gaps", lambda r: F.sequence(r["low"], r["high"])))
    return parts.select(*keys, "actor", F.coalesce("base", F.lit(0)).cast("long").alias("base"), cloud.alias("cloud"))


def from_vv(vector: DataFrame, keys: list[str], column: str = "vv") -> DataFrame:
    """The packed clock of a version vector, a map actor -> counter: no gaps."""
    each = vector.select(*keys, F.explode(column).alias("actor", "base"))
    return each.select(*keys, "actor", F.col("base").cast("long").alias("base"), F.array().cast("array<bigint>").alias("cloud"))


def add_dots(clock: DataFrame, dots: DataFrame) -> DataFrame:
    """The clock with more dots, which may close gaps when it is packed."""
    return merge(clock, dots.select(clock.columns))


def expand(packed: DataFrame) -> DataFrame:
    """The dots of packed clocks."""
    run = F.when(F.col("base") > 0, F.sequence(F.lit(1).cast("long"), F.col("base"))).otherwise(F.array().cast("array<bigint>"))
    keys = [c for c in packed.columns if c not in ("base", "cloud")]
    return packed.select(*keys, F.explode(F.concat(run, "cloud")).alias("cnt"))


def packed_seen(cnt: Column, base: Column, cloud: Column) -> Column:
    """Whether a packed clock has the dot, without expanding it; null clocks have none."""
    return F.coalesce((cnt <= base) | F.array_contains(cloud, cnt), F.lit(False))


def contiguous_seen(cnt: Column, base: Column) -> Column:
    return F.coalesce(cnt <= base, F.lit(False))


def contiguous_counter(packed: DataFrame, actor: str) -> DataFrame:
    """Base of ``actor`` in each clock (packed, or bases); evaluating it raises for a clock without the actor."""
    keys = [c for c in packed.columns if c not in ("actor", "base", "cloud")]
    own = packed.groupBy(*keys).agg(F.max(F.when(F.col("actor") == actor, F.col("base"))).alias("base"))
    missing = F.raise_error(F.lit(f"no counter for actor {actor}")).cast("long")
    return own.select(*keys, F.coalesce(F.col("base"), missing).alias("base"))


def get_dot(packed: DataFrame, keys: DataFrame, actor: str) -> DataFrame:
    """(keys, actor, cnt): the last contiguous dot, 0 if the actor is unknown."""
    own = packed.where(F.col("actor") == actor).select(*keys.columns, "base")
    return keys.join(own, keys.columns, "left").select(*keys.columns, F.lit(actor).alias("actor"), F.coalesce("base", F.lit(0)).cast("long").alias("cnt"))


def point_get(packed: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked's columns, fresh, base, cloud) of single clocks or tombstones: a missing one is fresh, that is empty."""
    got = asked.distinct().join(packed.withColumn("__there", F.lit(True)), asked.columns, "left")
    return got.select(*asked.columns, F.col("__there").isNull().alias("fresh"), F.coalesce("base", F.lit(0)).cast("long").alias("base"), F.coalesce("cloud", F.array().cast("array<bigint>")).alias("cloud"))


def actors(clock: DataFrame, keys: list[str]) -> DataFrame:
    return clock.select(*keys, "actor").distinct()


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_a, only_b, relation): equal, dominates, dominated or concurrent, from one aggregate."""
    dot = [*keys, "actor", "cnt"]
    both = a.select(*dot, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*dot, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(*dot).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = each.groupBy(*keys).agg(F.count(F.when(F.col("b") == 0, 1)).alias("only_a"), F.count(F.when(F.col("a") == 0, 1)).alias("only_b"))
    x, y = F.col("only_a") > 0, F.col("only_b") > 0
    relation = F.when(x & y, "concurrent").when(x, "dominates").when(y, "dominated").otherwise("equal")
    return out.withColumn("relation", relation)


def wide_compare(wide: DataFrame, pairs: dict[tuple[int, int], tuple[Column, Column]]) -> DataFrame:
    """(set_name, a, b, only_a, only_b, relation) for each pair of clocks, given as flags on a wide log: one aggregate.

    A set that neither clock of a pair has is in no row.
    """
    counts = []
    for (a, b), (x, y) in pairs.items():
        counts += [F.count(F.when(x & ~y, 1)).alias(f"a{a}{b}"), F.count(F.when(y & ~x, 1)).alias(f"b{a}{b}"), F.count(F.when(x | y, 1)).alias(f"n{a}{b}")]
    each = wide.groupBy("set_name").agg(*counts)
    one = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"a{a}{b}").alias("only_a"), F.col(f"b{a}{b}").alias("only_b"), F.col(f"n{a}{b}").alias("n"))
    out = each.select("set_name", F.explode(F.array(*[one(a, b) for a, b in pairs])).alias("p")).select("set_name", "p.*").where("n > 0").drop("n")
    x, y = F.col("only_a") > 0, F.col("only_b") > 0
    return out.withColumn("relation", F.when(x & y, "concurrent").when(x, "dominates").when(y, "dominated").otherwise("equal"))
