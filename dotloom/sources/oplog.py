"""Operation logs: who added or removed what, having observed which dots, and which replica got it.

An :class:`OpLog` holds four relations (all long form, one row per fact):

* ``ops(op_id, set_name, element, replica, op)``: op is add_blind, add_ctx or remove
* ``adds(op_id, set_name, element, replica, actor, cnt)``: the dot that each add minted
* ``delivery(op_id, r)``: replicas that received the operation
* ``ctx(op_id, set_name, element, actor, cnt)``: dots that the writer had observed

and derives each replica's state from them. ``wide`` is the same state with one row per dot and a
flag per replica, which whole reads use: a quorum merge is then a filter, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOT = ["set_name", "actor", "cnt"]
STATE = ["r", "set_name", "element", "actor", "cnt"]
REPLICAS = (0, 1, 2)

#: Operations of a (set, actor) that are numbered together in one task.
NUMBER_SPAN = 1 << 20


def actor_of(restarts: dict[int, list[int]] | None = None) -> Column:
    """The actor of an operation: its replica, and how often that had lost its store before.

    ``restarts`` has for a replica the op ids from which on it is a new incarnation.
    """
    epoch = F.lit(0)
    for replica, starts in (restarts or {}).items():
        for start in starts:
            epoch = epoch + F.when((F.col("replica") == replica) & (F.col("op_id") >= start), 1).otherwise(0)
    return F.concat(F.lit("r"), "replica", F.when(epoch > 0, F.concat(F.lit("."), epoch.cast("string"))).otherwise(F.lit("")))


def next_incarnation(status: dict, node: str, now: int) -> dict:
    """A store's status with a new actor id: node and epoch; the epoch is above the last one even if clocks go back."""
    epoch = max(now, status.get("last_epoch", 0) + 1)
    return {**status, "actor": f"{node}.{epoch}", "last_epoch": epoch}


def cleared_incarnation(status: dict) -> dict:
    """The status of a dropped store: without an actor, but with its epoch."""
    return {k: v for k, v in status.items() if k != "actor"}


def assign_dots(ops: DataFrame, start: DataFrame | None = None, span: int = NUMBER_SPAN, restarts: dict[int, list[int]] | None = None) -> DataFrame:
    """Mint a dot for each add: the next counter of (set, actor) in op order; removes mint none.

    Counters come from counts of op-id spans and numbers inside a span, so that no task holds all
    of an actor's operations. ``start(set_name, actor, base)`` has counters already used; ``restarts`` see actor_of().
    """
    adds = ops.where("op <> 'remove'").select("op_id", "set_name", "element", "replica", actor_of(restarts).alias("actor"), F.floor(F.col("op_id") / span).alias("span"))
    before = Window.partitionBy("set_name", "actor").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = adds.groupBy("set_name", "actor", "span").agg(F.count("*").alias("n"))
    spans = spans.select("set_name", "actor", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("set_name", "actor", "span").orderBy("op_id")
    numbered = adds.withColumn("k", F.row_number().over(inside)).join(spans, ["set_name", "actor", "span"])
    if start is not None:
        numbered = numbered.join(start, ["set_name", "actor"], "left").withColumn("before", F.col("before") + F.coalesce("base", F.lit(0)))
    return numbered.select("op_id", "set_name", "element", "replica", "actor", (F.col("before") + F.col("k")).cast("long").alias("cnt"))


def observed_ctx(ops: DataFrame, adds: DataFrame, delivery: DataFrame) -> DataFrame:
    """The local context of each add_ctx and remove: earlier dots of its element that its replica had received."""
    seen = adds.join(delivery, "op_id").select("set_name", "element", "actor", "cnt", F.col("op_id").alias("born"), "r")
    asks = ops.where("op <> 'add_blind'").select("op_id", "set_name", "element", F.col("replica").alias("r"))
    return asks.join(seen, ["set_name", "element", "r"]).where("born < op_id").select("op_id", "set_name", "element", "actor", "cnt")


def visible_ctx(ops: DataFrame, adds: DataFrame, delivered, replicas: tuple[int, ...] = REPLICAS, span: int = NUMBER_SPAN) -> DataFrame:
    """The context of each add_ctx and remove as its coordinator sees it: its element's dots that are visible there.

    ``delivered(r)`` says whether replica r got an operation. A dot goes at p with the first later operation
    with a context that reached p from a replica that had the dot; an operation at p that sees the dot is one of these
    itself. So a dot is in one context at each replica at most: that of the next such operation at p, if nothing
    removed the dot at p before. Next operations come from windows over spans of op ids and from the first
    ones of later spans, so that no task holds all operations of an element.
    """
    keys = ["set_name", "element"]
    told = lambda o, p: F.when((F.col("op") != "add_blind") & (F.col("replica") == o) & delivered(p), F.col("op_id"))
    names = {(o, p): f"next{o}{p}" for o in replicas for p in replicas}
    spanned = ops.withColumn("span", F.floor(F.col("op_id") / span))
    first = spanned.groupBy(*keys, "span").agg(*[F.min(told(o, p)).alias(n) for (o, p), n in names.items()])
    later = Window.partitionBy(*keys).orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    first = first.select(*keys, "span", *[F.min(n).over(later).alias(f"far_{n}") for n in names.values()])
    after = Window.partitionBy(*keys, "span").orderBy("op_id").rowsBetween(1, Window.unboundedFollowing)
    near = spanned.select(*keys, "span", "op_id", "op", "replica", *[F.min(told(o, p)).over(after).alias(n) for (o, p), n in names.items()])
    known = near.where("op <> 'remove'").join(first, [*keys, "span"])
    dots = adds.select("op_id", "actor", "cnt").join(known.select("op_id", *keys, "replica", *[F.least(n, f"far_{n}").alias(n) for n in names.values()]), "op_id")
    end = 1 << 62
    asked = []
    for p in replicas:
        gone = F.least(*[F.when(delivered(o), F.coalesce(names[o, p], F.lit(end))).otherwise(F.lit(end)) for o in replicas])
        asked.append(F.when(delivered(p) & (F.col(names[p, p]) == gone), F.col(names[p, p])))
    return dots.select(F.explode(F.array_compact(F.array(*asked))).alias("asks"), *keys, "actor", "cnt").withColumnRenamed("asks", "op_id")


@dataclass
class OpLog:
    ops: DataFrame
    adds: DataFrame
    delivery: DataFrame
    ctx: DataFrame
    wide: DataFrame | None = None

    @classmethod
    def from_relations(cls, ops: DataFrame, delivery: DataFrame, adds: DataFrame | None = None, ctx: DataFrame | None = None) -> OpLog:
        """Dots are minted, and contexts taken to be the local ones, where they aren't given."""
        adds = assign_dots(ops) if adds is None else adds
        return cls(ops, adds, delivery, observed_ctx(ops, adds, delivery) if ctx is None else ctx)

    @cached_property
    def delivered_adds(self) -> DataFrame:
        if self.wide is not None:
            return unpivot(self.wide, "delivered")
        return self.adds.join(self.delivery, "op_id").select(*STATE)

    @cached_property
    def removed(self) -> DataFrame:
        if self.wide is not None:
            return unpivot(self.wide, "removed")
        return self.ctx.join(self.delivery, "op_id").select(*STATE).distinct()

    @cached_property
    def held(self) -> DataFrame:
        """Dots on disk: delivered adds that no delivered context has superseded."""
        if self.wide is not None:
            return unpivot(self.wide, "held")
        return self.delivered_adds.join(self.removed.drop("element"), ["r", *DOT], "left_anti").select(*STATE)

    @cached_property
    def clock(self) -> DataFrame:
        """Dots seen: delivered adds and all context dots of delivered operations."""
        if self.wide is not None:
            return unpivot(self.wide, "seen")
        return self.delivered_adds.unionByName(self.removed).distinct()


    def clock_of(self, r: int) -> DataFrame:
        """(set_name, element, actor, cnt) that replica r has seen; on a wide log a filter."""
        relation = self.wide.where(F.col(f"seen{r}")) if self.wide is not None else self.clock.where(F.col("r") == r)
        return relation.select("set_name", "element", "actor", "cnt")

    def held_of(self, r: int) -> DataFrame:
        """(set_name, element, actor, cnt) that replica r holds."""
        relation = self.wide.where(F.col(f"held{r}")) if self.wide is not None else self.held.where(F.col("r") == r)
        return relation.select("set_name", "element", "actor", "cnt")

    def without_replica(self, r: int) -> OpLog:
        """The log after replica r lost its store: nothing was delivered to it. What it wrote lives on elsewhere.

        It comes back as a new actor, see assign_dots(): counters of a lost store mustn't be minted again.
        """
        return OpLog(self.ops, self.adds, self.delivery.where(F.col("r") != r), self.ctx)

    RELATIONS = ("ops", "adds", "delivery", "ctx")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the four relations below ``path``; mode ``append`` adds operations to a log that is there."""
        for name in self.RELATIONS:
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OpLog:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.RELATIONS])


def unpivot(wide: DataFrame, flag: str) -> DataFrame:
    """One row per replica whose flag is set."""
    at = F.array_compact(F.array(*[F.when(F.col(f"{flag}{r}"), F.lit(r)) for r in REPLICAS]))
    return wide.select(F.explode(at).alias("r"), "set_name", "element", "actor", "cnt")


def ops_from_events(events: DataFrame) -> DataFrame:
    """The op log in ``events``: set = event type, element = padded user, op and replica by id."""
    kind = F.col("event_id") % 4
    return events.select(
        F.col("event_id").alias("op_id"),
        F.col("event_type").alias("set_name"),
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("element"),
        (F.col("event_id") % 3).cast("int").alias("replica"),
        F.when(kind == 0, "add_blind").when(kind == 3, "remove").otherwise("add_ctx").alias("op"),
    )


def received(r: int):
    """Whether replica r got the operation."""
    return (F.col("replica") == r) | ((F.col("op_id") + 2 * r) % 5 < 2)


def deliveries(ops: DataFrame) -> DataFrame:
    at = F.array_compact(F.array(*[F.when(received(r), F.lit(r)) for r in REPLICAS]))
    return ops.select("op_id", F.explode(at).alias("r"))


def wide_state(ops: DataFrame, adds: DataFrame) -> DataFrame:
    """One row per dot with delivered, removed, held and seen flags for each replica.

    With local contexts a dot is superseded at r if an operation with a context came later, at a
    replica that had the dot, and reached r. So the latest such operation for each (origin, r) of
    an element is enough: nine maxima instead of a self join of the element's operations.
    """
    latest = [F.max(F.when((F.col("op") != "add_blind") & (F.col("replica") == o) & received(r), F.col("op_id"))).alias(f"last{o}{r}") for o in REPLICAS for r in REPLICAS]
    last = ops.groupBy("set_name", "element").agg(*latest)
    dots = adds.join(last, ["set_name", "element"])
    for r in REPLICAS:
        dots = dots.withColumn(f"delivered{r}", received(r))
    for r in REPLICAS:
        gone = F.lit(False)
        for o in REPLICAS:
            gone = gone | (F.col(f"delivered{o}") & F.coalesce(F.col(f"last{o}{r}") > F.col("op_id"), F.lit(False)))
        dots = dots.withColumn(f"removed{r}", gone)
    flags = [c for r in REPLICAS for c in (f"delivered{r}", f"removed{r}")]
    out = dots.select("op_id", "set_name", "element", "actor", "cnt", *flags)
    for r in REPLICAS:
        out = out.withColumn(f"held{r}", F.col(f"delivered{r}") & ~F.col(f"removed{r}")).withColumn(f"seen{r}", F.col(f"delivered{r}") | F.col(f"removed{r}"))
    return out


def events_log(spark: SparkSession, sf_dir: str) -> OpLog:
    ops = ops_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    adds, delivery = assign_dots(ops), deliveries(ops)
    return OpLog(ops, adds, delivery, observed_ctx(ops, adds, delivery), wide_state(ops, adds))
