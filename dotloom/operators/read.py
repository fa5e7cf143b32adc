"""Reads: local sets, quorum merges, ranges, membership, batches.

State relations are long form (r, set_name, element, actor, cnt). A merged read needs one
aggregate over dots, whatever the number of replicas; where the log is wide (a flag for each
replica in one row per dot) it needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOT = ["set_name", "element", "actor", "cnt"]


def visible(held: DataFrame, tombstone: DataFrame | None = None) -> DataFrame:
    """Held dots that no set-tombstone covers."""
    if tombstone is None:
        return held
    return held.join(tombstone.select("r", "set_name", "actor", "cnt"), ["r", "set_name", "actor", "cnt"], "left_anti")


def local_set(held: DataFrame, replica: int, tombstone: DataFrame | None = None) -> DataFrame:
    return visible(held, tombstone).where(F.col("r") == replica).drop("r")


def survivors(held: DataFrame, clock: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """Dots of the merged read: held somewhere, and nowhere seen without being held."""
    check_quorum(quorum)
    in_quorum = F.col("r").isin(*quorum)
    both = held.where(in_quorum).select("r", *DOT, F.lit(1).alias("h")).unionByName(clock.where(in_quorum).select("r", *DOT, F.lit(0).alias("h")))
    each = both.groupBy(*DOT).agg(F.sum("h").alias("held"), F.count("*").alias("n"))
    # A dot that is held is also seen: 2 held rows for 2 seen ones means nobody dropped it.
    return each.where("held > 0 and n = 2 * held").select(*DOT)


def live_flag(quorum: tuple[int, ...]) -> Column:
    """On a wide log: whether the merged read of the quorum has the dot."""
    check_quorum(quorum)
    some, dropped = F.lit(False), F.lit(False)
    for r in quorum:
        some = some | F.col(f"held{r}")
        dropped = dropped | (F.col(f"seen{r}") & ~F.col(f"held{r}"))
    return some & ~dropped


def wide_survivors(wide: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """The same on a wide log: a filter."""
    return wide.where(live_flag(quorum)).select(*DOT)


def check_quorum(quorum: tuple[int, ...], least: int = 1) -> None:
    if len(set(quorum)) != len(quorum) or len(quorum) < least:
        raise ValueError(f"a quorum needs {least} or more different replicas: {quorum}")


def dots_text(order: tuple[str, str] = ("actor", "cnt")) -> Column:
    """actor:cnt pairs of a group in order, joined by commas; a group is one element's dots."""
    pair = F.struct(*order)
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda d: F.concat(d["actor"], F.lit(":"), d["cnt"].cast("string"))), ",")


def by_element(dots: DataFrame) -> DataFrame:
    """(set_name, element, n_dots, dots)."""
    return dots.groupBy("set_name", "element").agg(F.count("*").alias("n_dots"), dots_text().alias("dots"))


def merge_arrays(held_a: Column, held_b: Column, seen_a: Column, seen_b: Column) -> Column:
    """An element's merged dots from two replicas' arrays: held by both, or by one and unseen by the other."""
    both = F.array_intersect(held_a, held_b)
    return F.array_sort(F.array_union(both, F.array_union(F.array_except(held_a, seen_b), F.array_except(held_b, seen_a))))


def in_range(dots: DataFrame, start: str | None = None, end: str | None = None, start_inclusive: bool = True, end_inclusive: bool = True) -> DataFrame:
    """Elements from start to end; either may be open. The bounds reach the scan as filters."""
    check_range(start, end, start_inclusive, end_inclusive)
    e = F.col("element")
    if start is not None:
        dots = dots.where(e >= start if start_inclusive else e > start)
    if end is not None:
        dots = dots.where(e <= end if end_inclusive else e < end)
    return dots


def check_range(start=None, end=None, start_inclusive=True, end_inclusive=True) -> None:
    for name, value in (("range_start", start), ("range_end", end)):
        if value is not None and not isinstance(value, (str, bytes)):
            raise ValueError(f"{name} must be a string or bytes: {value!r}")
    for name, value in (("start_inclusive", start_inclusive), ("end_inclusive", end_inclusive)):
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false: {value!r}")
    if start is not None and end is not None and start > end:
        raise ValueError(f"range_start {start!r} is after range_end {end!r}")


def subset(dots: DataFrame, members: DataFrame) -> DataFrame:
    """Dots of the given (set_name, element) rows; repeats in ``members`` change nothing.

    A left-semi join: Spark broadcasts the members if their size allows, else shuffles both sides.
    """
    return dots.join(members.select("set_name", "element").distinct(), ["set_name", "element"], "left_semi")


def membership(dots: DataFrame, members: DataFrame) -> DataFrame:
    """(set_name, element, is_member, n_dots, dots) for each distinct member asked for."""
    asked = members.select("set_name", "element").distinct()
    found = by_element(subset(dots, members))
    out = asked.join(found, ["set_name", "element"], "left")
    return out.select("set_name", "element", F.col("n_dots").isNotNull().alias("is_member"), F.coalesce("n_dots", F.lit(0)).cast("long").alias("n_dots"), F.coalesce("dots", F.lit("")).alias("dots"))


def contains_all(dots: DataFrame, members: DataFrame) -> DataFrame:
    """(set_name, is_subset) for each set asked about."""
    return membership(dots, members).groupBy("set_name").agg(F.bool_and("is_member").alias("is_subset"))


#: Rows that one task numbers, and parts of a relation at most.
PART_ROWS = 1 << 18
MAX_PARTS = 4096
_FAN = 64


def _part_of(key: Column, splits: list) -> Column:
    """How many split points are not above the key: every 64th first, then those behind the last of these."""
    if not splits:
        return F.lit(0)
    points = F.array(*map(F.lit, splits))
    reached = lambda some: F.size(F.filter(some, lambda x: x <= key))
    if len(splits) <= _FAN:
        return reached(points)
    coarse = F.array(*map(F.lit, splits[_FAN - 1 :: _FAN]))
    block = reached(coarse)
    return block * _FAN + reached(F.slice(points, block * _FAN + 1, F.lit(_FAN)))


def positions(rows: DataFrame, group: str, key: str, ties: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``position``: the place from 1 on of each row in its group, in order of ``key`` (then ``ties``).

    Ranges between split points are numbered by themselves and offset by the counts before them,
    so that one large group is many tasks. The split points are a sample of a few for each part, by hash.
    """
    parts = min(MAX_PARTS, max(1, -(-rows.count() // part_rows)))
    some = sorted(r[0] for r in rows.select(key).distinct().orderBy(F.xxhash64(key), key).limit(8 * parts).collect()) if parts > 1 else []
    ranged = rows.withColumn("__part", _part_of(F.col(key), some[8::8]))
    here = F.row_number().over(Window.partitionBy(group, "__part").orderBy(key, *(ties or [])))
    counts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__k", here).join(offsets, [group, "__part"])
    return placed.select(*rows.columns, (F.col("__before") + F.col("__k")).cast("long").alias("position"))


def numbered(elements: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(set_name, element, position): elements' places from 1 in each set."""
    return positions(elements.select("set_name", "element").distinct(), "set_name", "element", part_rows=part_rows)


def batched(elements: DataFrame, batch_size: int) -> DataFrame:
    """(set_name, batch, n, first, last): ordered batches of exactly ``batch_size`` but for the last."""
    at = numbered(elements)
    batch = F.floor((F.col("position") - 1) / batch_size).alias("batch")
    return at.select("set_name", batch, "element").groupBy("set_name", "batch").agg(F.count("*").alias("n"), F.min("element").alias("first"), F.max("element").alias("last"))


def least_last(held: DataFrame, quorum: tuple[int, ...]) -> DataFrame:
    """(set_name, frontier): up to here all replicas of the quorum have answered; null if one is empty."""
    last = held.where(F.col("r").isin(*quorum)).groupBy("set_name", "r").agg(F.max("element").alias("last"))
    out = last.groupBy("set_name").agg(F.min("last").alias("frontier"), F.count("*").alias("n"))
    return out.select("set_name", F.when(F.col("n") == len(quorum), F.col("frontier")).alias("frontier"))


def not_found(sets: DataFrame, clock: DataFrame, replica: int) -> DataFrame:
    """Sets asked for of which a replica has no clock."""
    return sets.select("set_name").distinct().join(clock.where(F.col("r") == replica), ["set_name"], "left_anti")
