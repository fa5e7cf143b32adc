"""Element sources: word files and synthetic sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_words(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(element): lines of text files without a trailing carriage return; at most ``limit`` of them."""
    words = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("element"))
    return words if limit is None else words.limit(limit)


def random_elements(spark: SparkSession, n: int, size: int = 100, seed: int = 0) -> DataFrame:
    """(position, element): n pseudo-random hex strings of ``size`` characters, the same for a seed."""
    pieces = [F.sha2(F.concat_ws("-", F.lit(seed), "id", F.lit(k)), 256) for k in range(-(-size // 64))]
    return spark.range(n).select(F.col("id").alias("position"), F.substring(F.concat(*pieces), 1, size).alias("element"))


def batches_of(elements: DataFrame, batches: int, size: int = 1000, seed: int = 0) -> DataFrame:
    """(batch, element): runs of ``size`` neighbours from pseudo-random starts; ``elements`` has position.

    Few runs meet many elements: the runs are broadcast, two numbers each for ``batches`` of them.
    """
    n = elements.count()
    spark = elements.sparkSession
    starts = spark.range(batches).select(F.col("id").alias("batch"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n - size + 1))).alias("start"))
    places = starts.select("batch", F.explode(F.sequence("start", F.col("start") + min(size, n) - 1)).alias("position"))
    return places.join(elements, "position").select("batch", "element")


def add_ops(elements: DataFrame, set_name: str, replica: int = 0) -> DataFrame:
    """Operations that add each (position, element) blindly to a set."""
    return elements.select(F.col("position").alias("op_id"), F.lit(set_name).alias("set_name"), "element", F.lit(replica).alias("replica"), F.lit("add_blind").alias("op"))
