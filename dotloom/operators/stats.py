"""Statistics of read times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, value: str, keys: list[str], digits: int = 3) -> DataFrame:
    """(keys, n, low, high, total, mean); sums of doubles are rounded, for their order is not fixed."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.sum(v), digits).alias("total"), F.round(F.avg(v), digits).alias("mean"))


def histogram(df: DataFrame, value: str, width: float, keys: list[str]) -> DataFrame:
    """(keys, bucket, n): linear buckets; bucket is the lower edge. Nulls are left out."""
    if width <= 0:
        raise ValueError("width must be above 0")
    bucket = (F.floor(F.col(value) / width) * width).cast("double").alias("bucket")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.count("*").alias("n"))
