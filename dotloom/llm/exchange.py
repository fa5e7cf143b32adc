"""Packed exchanges: tasks send arrays, not rows.

A row is (pid, src, kind, data): bucket, sender, what it is, and bytes of arrays. A shuffle brings
the rows of a bucket together; it moves few, large rows whose number doesn't depend on how often a
key occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "pid long, src long, kind int, data binary"
_NAMES = ["pid", "src", "kind", "data"]


def rows(items: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*items, strict=True)) if items else [(), (), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], _NAMES)


def dealt(pid: np.ndarray, n: int, arrays: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(bucket, bytes of each array's part, end to end) for the buckets that have items."""
    order = np.argsort(pid, kind="stable")
    cuts = np.searchsorted(pid[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    return [(b, b"".join(a[x:y].tobytes() for a in arrays)) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]


def numbered(pid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of items by bucket, first place of each bucket and the end): an item's number is its place in that order."""
    order = np.argsort(pid, kind="stable")
    return order, np.searchsorted(pid[order], np.arange(n + 1))


def taken(data: bytes, kinds: list) -> list[np.ndarray]:
    """The arrays of one packed row again."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * size
    return out


def source_number() -> int:
    """A number for what this task sends, the same if the task is run again."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 24


def home(src: int, buckets: int) -> int:
    """The bucket through which a sender's own tables go back to it: senders' homes are spread over all."""
    return ((src >> 24) + (src & ((1 << 24) - 1))) % buckets


#: Bits of a membership filter: 2 MB whatever the input; keys that share a bit only let more rows through.
FILTER_BITS = 1 << 24


def membership_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size of the keys' low bits, made by Spark's bitmap aggregates."""
    spot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    parts = keys.select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32768 + 1, 4096), np.uint8)
    for r in parts:
        out[r.b] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys.astype(np.int64) % FILTER_BITS
    flat = bitmap.ravel()
    # Spark's bitmap buckets hold (32768 * (b - 1), 32768 * b] for positive values, and start with bucket 0 for 0 and below.
    bucket, position = np.where(spot > 0, 1 + (spot - 1) // 32768, 0), np.where(spot > 0, (spot - 1) % 32768, 0)
    at = bucket * 4096 + position // 8
    return (flat[at] >> (position % 8).astype(np.uint8) & 1).astype(bool)
