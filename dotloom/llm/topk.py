"""Exact inner-product search: a ball tree per shard, searched by branch and bound.

Vectors become integers floor(scale * x). Rows go to the nearest of at most ``MAX_CELLS`` centres, a sample
of the vectors; a cell with more rows than a shard takes is dealt by hash into several. Each shard
task builds a ball tree and answers blocks of queries, always opening the node with the largest
upper bound ``q.c + |q| r`` first and leaving a node once the bound is below the query's current
k-th score. That score is shared in rounds: first a query meets one shard of the cell with the highest
bound, then the shards of the next best cells, then all others; a query is sent to a cell only while
the cell's ball may reach the k-th score that the rounds before have found.

Nothing grows on one task: a shard meets query blocks one at a time, and k rows a query and shard
come back. The driver holds the centres, radii and counts of cells, whatever the number of rows.

Defined results: vectors that are null, or hold null or non-finite components, take no part;
vectors of another length than the query's are compared on no query (they take no part either:
the length most rows have is the table's); ties go to the smaller id; a repeated id is a candidate
for each of its rows, and a query for one row, the first by its vector; the query's own id is no
candidate; components whose products don't fit 64 bits raise a ValueError; an empty base or no queries
give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, deal, materialize, tidy

_LEAF = 64


class BallTree:
    """Splits on the two far ends of a ball; equal vectors end in one leaf of radius 0."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = _LEAF):
        self.nodes: list[tuple] = []  # (centre, radius, low, high, left, right)
        order = np.lexsort((ids,))
        self._v, self._order = vectors[order].astype(np.float64), np.arange(len(ids))
        if len(ids):
            self._split(0, len(ids), leaf)
        self.ids = ids[order][self._order]
        self.vectors = vectors[order][self._order]
        del self._v

    def _split(self, low: int, high: int, leaf: int) -> int:
        """Builds with an explicit stack, for depth may be large on skewed data."""
        root = len(self.nodes)
        self.nodes.append(None)
        stack = [(root, low, high)]
        while stack:
            at, a, b = stack.pop()
            part = self._v[self._order[a:b]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            radius = float(away.max()) * (1 + 1e-9) + 1e-6
            left = right = -1
            if b - a > leaf and away.max() > 1e-9:
                first = part[int(away.argmax())]
                d1 = ((part - first) ** 2).sum(axis=1)
                second = part[int(d1.argmax())]
                d2 = ((part - second) ** 2).sum(axis=1)
                rank = np.argsort(d1 - d2, kind="stable")
                near = int((d1 <= d2).sum())
                near = near if 0.1 * (b - a) <= near <= 0.9 * (b - a) else (b - a) // 2
                self._order[a:b] = self._order[a:b][rank]
                left, right = len(self.nodes), len(self.nodes) + 1
                self.nodes += [None, None]
                stack += [(left, a, a + near), (right, a + near, b)]
            self.nodes[at] = (centre, radius, a, b, left, right)
        return root

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The best k (score, id) that reach ``floor``; every tie with the k-th of smaller id is seen."""
        import heapq

        if not self.nodes:
            return []
        q = query.astype(np.float64)
        norm = math.sqrt(float(q @ q))
        bound = lambda n: float(q @ n[0]) + norm * n[1] * (1 + 1e-9)
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        todo = [(-bound(self.nodes[0]), 0)]
        while todo:
            up, at = heapq.heappop(todo)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -up + 1e-3 < kth:
                break
            _, _, a, b, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    u = bound(self.nodes[child])
                    if u + 1e-3 >= kth:
                        heapq.heappush(todo, (-u, child))
                continue
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                item = (int(scores[i]), -int(self.ids[a + i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _pack(df: DataFrame, key: str) -> DataFrame:
    """One row of packed ids and vectors for each value of ``key`` (bounded groups) and input task batch."""

    def run(batches):
        for value, part in by_key(batches, key):
            ids = part.column("id").to_numpy()
            flat = part.column("v").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            floors = part.column("floor").to_numpy().astype(np.float64)
            yield pa.record_batch([pa.array([value], pa.int64()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([flat.flatten().to_numpy().astype(np.int64).tobytes()]), pa.array([floors.tobytes()])], [key, "ids", "vs", "floors"])

    return deal(df.select(key, "id", "v", "floor"), key, ["id"]).mapInArrow(tidy(run), f"{key} long, ids binary, vs binary, floors binary")


def _search(k: int, dim: int):
    """Rows of one shard: its vectors (block null), then query blocks."""

    def run(batches):
        for shard, part in by_key(batches, "shard"):
            tree = None
            for row in part.sort_by([("block", "ascending")]).to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vs = np.frombuffer(row["vs"], np.int64).reshape(len(ids), dim)
                if row["block"] < 0:
                    tree = BallTree(ids, vs)
                    continue
                if tree is None:
                    continue
                out: list[tuple[int, int, int]] = []
                for own, vector, floor in zip(ids, vs, np.frombuffer(row["floors"]), strict=True):
                    out += [(int(own), i, s) for s, i in tree.search(vector, int(own), k, float(floor))]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

    return run


#: Cells of the base; their centres and radii go to all tasks.
MAX_CELLS = 1024
#: Room for rounding in a cell's bound, as a part of |q| (|c| + r).
_SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """Balls around centres: who is in which cell, and which shards a cell has."""

    centres: np.ndarray
    radii: np.ndarray
    first_shard: np.ndarray  # and the end

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each cell can have with each query."""
        norm = np.sqrt((queries**2).sum(axis=1))[:, None]
        room = norm * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)[None, :] * _SLACK
        return queries @ self.centres.T + norm * self.radii[None, :] + room + 1e-3


def _nearest(centres: np.ndarray):
    """(id, v, cell, away): the nearest centre and the distance to it."""

    def run(batches):
        square = (centres**2).sum(axis=1)
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            cell = (square[None, :] - 2 * flat @ centres.T).argmin(axis=1)
            away = np.sqrt(((flat - centres[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int64)), pa.array(away)], ["id", "v", "cell", "away"])

    return run


def _send(cells: Cells, stage: int, best_cells: int):
    """Packed query blocks for the shards of a round: the best cell's first shard (0), the next best cells (1), the rest (2)."""

    def run(batches):
        ends = cells.first_shard
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vs = np.frombuffer(row["vs"], np.int64).reshape(len(ids), -1)
                floors = np.frombuffer(row["floors"])
                bounds = cells.bounds(vs.astype(np.float64))
                rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
                wanted = rank == 0 if stage == 0 else (bounds >= floors[:, None]) & ((rank < best_cells) if stage == 1 else (rank >= best_cells))
                out = []
                for cell in np.flatnonzero(wanted.any(axis=0)).tolist():
                    some = np.flatnonzero(wanted[:, cell])
                    shards = np.arange(ends[cell], ends[cell + 1])
                    at = ids[some] % len(shards)  # where a query of this cell starts
                    for k, shard in enumerate(shards.tolist()):
                        if stage == 0:
                            mine = some[at == k]
                        else:  # the first shard of the best cell has been searched
                            mine = some[(rank[some, cell] > 0) | (at != k)]
                        if len(mine):
                            out.append((shard, row["block"], ids[mine].tobytes(), vs[mine].tobytes(), floors[mine].tobytes()))
                            if len(out) == 16:
                                yield _packed(out)
                                out = []
                if out:
                    yield _packed(out)

    return run


def _packed(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "block", "ids", "vs", "floors"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cells(vectors: DataFrame, n: int, shard_rows: int) -> tuple[DataFrame, Cells]:
    """The base with its shards, and its cells: the driver gets a bounded sample and a row for each cell."""
    wanted = max(1, min(MAX_CELLS, -(-n // shard_rows)))
    centres = np.array([r.v for r in vectors.orderBy(F.xxhash64("id", "v"), "id").limit(wanted).collect()], np.float64)
    placed = materialize(vectors.mapInArrow(tidy(_nearest(centres)), "id long, v array<long>, cell long, away double"), "topk-cells")
    held = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    shards = [-(-held[c].n // shard_rows) if c in held else 0 for c in range(len(centres))]
    cells = Cells(centres, np.array([held[c].away * (1 + 1e-9) + 1e-6 if c in held else -np.inf for c in range(len(centres))]), np.r_[0, np.cumsum(shards)])
    fine = np.array([c in held for c in range(len(centres))])
    live = Cells(centres[fine], cells.radii[fine], np.r_[cells.first_shard[:-1][fine], cells.first_shard[-1]])
    first, many = cells.first_shard, np.maximum(1, np.array(shards))

    def dealt(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            shard = first[cell] + batch.column("h").to_numpy() % many[cell]
            yield pa.record_batch([pa.array(shard), batch.column("id"), batch.column("v"), pa.array(np.full(len(cell), -np.inf))], ["shard", "id", "v", "floor"])

    # The vector counts, too, so that rows that repeat one id are spread.
    hashed = placed.select("cell", F.xxhash64("id", "v").alias("h"), "id", "v")
    return hashed.mapInArrow(tidy(dealt), "shard long, id long, v array<long>, floor double"), live


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over ``base``."""
    spark = base.sparkSession

    def ready(df):
        x = F.col(vec_col)
        fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
        return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))

    vectors = materialize(ready(base), "topk-base")
    found = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).orderBy(F.desc("count"), "n").head()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if found is None or found["n"] == 0:
        return empty
    dim = found["n"]
    asked = materialize(ready(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "topk-asked")
    size = asked.agg(F.count("*").alias("n"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).head()
    if not size["n"]:
        return empty
    if max(found["high"], -found["low"]) * max(size["high"], -size["low"]) * dim >= 1 << 62:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    packed, cells = _cells(vectors.where(F.size("v") == dim), found["count"], shard_rows)
    base_shards = materialize(_pack(packed, "shard"), "topk-shards").select("shard", F.lit(-1).cast("long").alias("block"), "ids", "vs", "floors")
    # Queries near each other are one block, so that a block meets few cells.
    n_blocks = max(1, -(-size["n"] // block_rows))
    placed = asked.mapInArrow(tidy(_nearest(cells.centres)), "id long, v array<long>, cell long, away double")
    around = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(max(1, n_blocks // 64)))).orderBy("cell", "id")
    number = F.floor((F.row_number().over(around) - 1) / block_rows) + F.pmod(F.xxhash64("id"), F.lit(max(1, n_blocks // 64))) * (1 << 32)
    asked = materialize(placed.select("id", "v", number.cast("long").alias("block")), "topk-queries")
    best: DataFrame | None = None
    for stage in (0, 1, 2):
        known = asked
        if best is not None:  # k vectors reach the k-th score so far: a sound floor everywhere
            reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
            known = asked.join(reached, "id", "left")
        known = known.select("block", "id", "v", F.coalesce(F.col("floor"), F.lit(float("-inf"))).alias("floor") if best is not None else F.lit(float("-inf")).alias("floor"))
        sent = _pack(known, "block").mapInArrow(tidy(_send(cells, stage, max(2, len(cells.radii) // 8))), "shard long, block long, ids binary, vs binary, floors binary")
        got = deal(base_shards.unionByName(sent), "shard").mapInArrow(tidy(_search(k, dim)), "query_id long, vec_id long, score long")
        best = _best(got if best is None else best.select("query_id", "vec_id", "score").unionByName(got), k).select("query_id", "rank", "vec_id", "score")
        if cells.first_shard[-1] == 1 or stage == 2:
            break
        best = materialize(best, f"topk-round{stage}")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
