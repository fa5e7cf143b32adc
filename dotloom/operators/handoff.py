"""Handoff: one replica takes another's state; and compaction of what tombstones cover.

With clock C, held K and tombstone T of sender s and receiver r:
clock' = Cs | Cr, held' = Kr | (Ks - Cr), tombstone' = Tr | ((Cs - Ks) & Cr).
Tombstoned keys are not sent. After it the receiver's visible keys are the merged read of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .read import DOT


@dataclass
class Handoff:
    clock: DataFrame
    held: DataFrame
    tombstone: DataFrame

    @property
    def visible(self) -> DataFrame:
        return self.held.join(self.tombstone, DOT, "left_anti")


def _of(relation: DataFrame, r: int) -> DataFrame:
    return relation.where(F.col("r") == r).select(*DOT)


def hand_off(held: DataFrame, clock: DataFrame, sender: int, receiver: int, tombstone: DataFrame | None = None) -> Handoff:
    """The receiver's state after it got all of the sender's keys and the end of the handoff.

    One aggregate by dot tells all three relations.
    """
    if sender == receiver:
        raise ValueError("a replica can't hand off to itself")
    flags = {"ks": _of(held, sender), "kr": _of(held, receiver), "cs": _of(clock, sender), "cr": _of(clock, receiver)}
    if tombstone is not None:
        flags |= {"ts": _of(tombstone, sender), "tr": _of(tombstone, receiver)}
    names = ["ks", "kr", "cs", "cr", "ts", "tr"]
    every = None
    for name, relation in flags.items():
        one = relation.select(*DOT, *[F.lit(n == name).alias(n) for n in names])
        every = one if every is None else every.unionByName(one)
    dots = every.groupBy(*DOT).agg(*[F.bool_or(n).alias(n) for n in names])
    sent = F.col("ks") & ~F.col("ts")
    return Handoff(
        dots.where("cs or cr").select(*DOT),
        dots.where(F.col("kr") | (sent & ~F.col("cr"))).select(*DOT),
        dots.where(F.col("tr") | (F.col("cs") & ~sent & F.col("cr"))).select(*DOT),
    )


def hand_off_many(held: DataFrame, clock: DataFrame, senders: tuple[int, ...], receiver: int) -> Handoff:
    """The receiver's state after handoffs of several senders, one after the other."""
    out: Handoff | None = None
    tag = lambda df, r: df.select(F.lit(r).alias("r"), *DOT)
    for sender in senders:
        if out is None:
            out = hand_off(held, clock, sender, receiver)
            continue
        theirs = tag(_of(held, sender), sender), tag(_of(clock, sender), sender)
        out = hand_off(theirs[0].unionByName(tag(out.held, receiver)), theirs[1].unionByName(tag(out.clock, receiver)), sender, receiver, tag(out.tombstone, receiver))
    if out is None:
        raise ValueError("no senders")
    return out


def wide_hand_off(wide: DataFrame, sender: int, receiver: int) -> Handoff:
    """The same on a wide log, from an empty tombstone: three filters."""
    if sender == receiver:
        raise ValueError("a replica can't hand off to itself")
    ks, kr, cs, cr = (F.col(f"{k}{r}") for k in ("held", "seen") for r in (sender, receiver))
    held, tomb = kr | (ks & ~cr), cs & ~ks & cr
    return WideHandoff(wide.where(cs | cr).select(*DOT), wide.where(held).select(*DOT), wide.where(tomb).select(*DOT), wide.where(held & ~tomb).select(*DOT))


@dataclass
class WideHandoff(Handoff):
    kept: DataFrame

    @property
    def visible(self) -> DataFrame:
        return self.kept


def compact(held: DataFrame, tombstone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held without tombstoned dots, the empty tombstone)."""
    return held.join(tombstone, tombstone.columns, "left_anti"), tombstone.limit(0)


def route_tombstones(dots: DataFrame, clock: DataFrame) -> DataFrame:
    """Where each dot to suppress goes: seen ones to the tombstone, unseen ones to the clock."""
    known = clock.select(*DOT).distinct().withColumn("seen", F.lit(True))
    return dots.join(known, DOT, "left").select(*DOT, F.when(F.col("seen"), "tombstone").otherwise("clock").alias("target"))
