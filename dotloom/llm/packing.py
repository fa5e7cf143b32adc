"""Best-fit-decreasing packing of token pieces, planned on the histogram of lengths.

A length is at most the capacity, so the counts of the lengths say all that best-fit decreasing
needs: one small plan for any number of documents. Pieces are placed longest first into the open
bin with the least room that takes them; a segment tree over the possible remaining capacities
finds it in logarithmic time. Pieces of equal length are placed together: the tightest bins each
take as many as fit, which is where one-by-one placement would put them.

The plan is a list of runs (length, first number, bins, pieces a bin, offset). Pieces learn their
number among those of their length from counts by task, and find their place by binary search.

Defined results: a null or empty text is a document of the end token alone; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import token_pieces


class CapacityTree:
    """Segment tree over remaining capacities 0..size-1: which of them have open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size - 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` with an open bin, or -1."""
        i = need + self.leaves
        if need >= self.leaves:
            return -1
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counted lengths: (runs, bins used).

    A run is (length, first number, pieces, first bin, pieces a bin, offset in the bin).
    """
    tree = CapacityTree(capacity + 1)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # capacity left: (first bin, bins)
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def add(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in open_bins:
                open_bins[room] = []
                tree.set(room, True)
            open_bins[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("lengths must be in 1..capacity")
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, bins = used, -(-left // each)
                used += bins
            else:
                each = room // length
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    tree.set(room, False)
                take = min(bins, -(-left // each))
                add(room, first + take, bins - take)
                bins = take
            pieces = min(left, bins * each)
            runs.append((length, number, pieces, first, each, capacity - room))
            full, rest = divmod(pieces, each)
            add(room - each * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            number += pieces
            left -= pieces
    return runs, used


def _place(runs: np.ndarray):
    def run(batches):
        starts = runs[:, 0] * (1 << 40) + runs[:, 1]  # by length, then number
        order = np.argsort(starts)
        ranked, starts = runs[order], starts[order]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            r = ranked[np.searchsorted(starts, length * (1 << 40) + number, side="right") - 1]
            j = number - r[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(r[:, 3] + j // r[:, 4]), pa.array(r[:, 5] + j % r[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, lexicon_name: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, capacity, text_col, id_col, vocabulary_path, lexicon_name), "pieces")
    by_task = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    runs, _ = plan_best_fit(histogram, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("number"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    return numbered.mapInArrow(tidy(_place(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
