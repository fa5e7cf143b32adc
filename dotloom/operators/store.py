"""A replica's store as rows of binary keys: dumps, folds, emptiness and size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from .read import positions

_RANK = {"clock": 0, "tombstone": 1, "element": 2, "end": 3}


def keys_of(held: DataFrame, clock: DataFrame, layout: str = "nul") -> DataFrame:
    """(key): one replica's keys, from its dots (set_name, element, actor, cnt) held and seen.

    Each (set, actor) seen has a clock and a tombstone key, each set an end key.
    """
    make = codec.maker(layout)
    s, e, a = F.col("set_name"), F.col("element"), F.col("actor")
    keys = held.select(make("element", s, e, a, F.col("cnt")).alias("key"))
    meta = clock.select("set_name", "actor").distinct()
    for what in ("clock", "tombstone"):
        keys = keys.unionByName(meta.select(make(what, s, actor=a).alias("key")))
    return keys.unionByName(meta.select("set_name").distinct().select(make("end", s).alias("key")))


def dump(keys: DataFrame, layout: str = "nul") -> DataFrame:
    """(key, kind, set_name, element, actor, cnt): every key of a store, decoded."""
    return codec.decode(keys, layout)


def dump_set(keys: DataFrame, set_name: str, layout: str = "nul") -> DataFrame:
    """(set_name, kind, element, actor, cnt, place): a set's keys in the order of the store: clock, tombstone, elements, end."""
    d = dump(keys, layout).where(F.col("set_name") == set_name)
    rank = F.lit(_RANK["end"])
    for kind, n in _RANK.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    # The first part of the order; strings of columns compare as the columns do but for elements that hold \x01.
    d = d.withColumn("__order", F.concat_ws("\x01", rank.cast("string"), F.coalesce("element", F.lit(""))))
    placed = positions(d.drop("key"), "set_name", "__order", ["element", "actor", "cnt"])
    return placed.select("set_name", "kind", "element", "actor", "cnt", F.col("position").alias("place"))


def run_fold(keys: DataFrame, fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, layout: str = "nul") -> DataFrame:
    """A user function over a store's decoded keys, in batches of pandas frames, task by task.

    What a fold gives for each task is combined by the caller's aggregate, so no task sees the whole store.
    """
    return dump(keys, layout).mapInPandas(fold, schema)


def store_size(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, is_empty, n_keys, n_bytes) of stores; one without keys is in no row, see is_empty()."""
    out = keys.groupBy(*by).agg(F.count("*").alias("n_keys"), F.sum(F.octet_length("key")).cast("long").alias("n_bytes"))
    return out.select(*by, (F.col("n_keys") == 0).alias("is_empty"), "n_keys", "n_bytes")


def is_empty(keys: DataFrame) -> bool:
    return keys.isEmpty()
