"""Nearest neighbours by largest inner product: stable random projections in a kd-tree.

Vectors of a shard get one more component that makes all of them as long as the longest, so the largest
inner product is the smallest distance. They are projected to ``DIMENSIONS`` normal combinations, which
a kd-tree holds. A query takes the tree's leaves in order of their distance in the projection and
verifies their vectors in full. The squared projected distance of a vector over its squared true distance
follows a chi-square law, so once the next leaf is so far away that a vector as near as the k-th best
found would lie within with probability ``CONFIDENCE``, the search ends.

Every vector is indexed. Equal vectors are one point that carries its smallest ids, k + 1 of them: with
ties going to the smaller id no other can be among k neighbours, so a vector in a third of all rows is one
point. Shards and blocks of queries are bounded; a cell of the grid is one of either.

Cases: rows with a null id, and vectors null, empty, zero or with null or non-finite components, take no
part. Vectors of different lengths are not compared. Of rows with the same id the smallest vector counts.
Fewer candidates than k are all returned. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
DIMENSIONS = 8
CONFIDENCE = 0.98
LEAF = 256
SHARD_ROWS = 1 << 14
QUERY_ROWS = 1 << 15
SEED = 20


def chi_square(x: float, degrees: int = DIMENSIONS) -> float:
    """Probability that a chi-square variable of an even number of degrees is at most x."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def quantile(p: float, degrees: int = DIMENSIONS) -> float:
    """The x with ``chi_square(x) = p``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class KdTree:
    """Median splits along the widest side; leaves are runs of ``order``, nodes keep their boxes."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.low, self.high, self.run, self.child = [], [], [], []
        self.points = points
        self._build(0, len(points))

    def _build(self, begin: int, end: int) -> int:
        own = self.order[begin:end]
        at = self.points[own]
        number = len(self.run)
        self.low.append(at.min(axis=0))
        self.high.append(at.max(axis=0))
        self.run.append((begin, end))
        self.child.append(())
        if end - begin > LEAF:
            side = int(np.argmax(self.high[number] - self.low[number]))
            middle = (end - begin) // 2
            self.order[begin:end] = own[np.argpartition(at[:, side], middle)]
            self.child[number] = (self._build(begin, begin + middle), self._build(begin + middle, end))
        return number

    def arrays(self) -> None:
        self.low, self.high = np.array(self.low), np.array(self.high)

    def leaves(self, point: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(squared distance, begin, end) of leaves, nearest first."""
        outside = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        distance = np.einsum("ij,ij->i", outside, outside).tolist()
        heap = [(distance[0], 0)]
        while heap:
            far, number = heapq.heappop(heap)
            if self.child[number]:
                for c in self.child[number]:
                    heapq.heappush(heap, (distance[c], c))
            else:
                yield far, *self.run[number]


class Shard:
    """The vectors of a shard with their ids, projected and indexed."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]) -> None:
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.longest = float(squares.max())
        level = np.sqrt(np.maximum(self.longest - squares, 0))
        self.normal = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, DIMENSIONS))
        self.tree = KdTree(np.column_stack((vectors, level)) @ self.normal)
        self.tree.arrays()
        self.vectors = vectors[self.tree.order]
        self.ids = [ids[i] for i in self.tree.order]
        self.numbers = np.arange(len(vectors))
        self.limit = quantile(CONFIDENCE)

    def search(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places of about the k points of largest inner product.

        Leaves are verified in batches, each as large as all before it, and the test is made between them.
        """
        square = float(query @ query) + self.longest
        best, place = np.empty(0), np.empty(0, dtype=np.int64)
        scores: list[np.ndarray] = []
        places: list[np.ndarray] = []
        seen = rows = 0
        nearest = math.inf
        for far, begin, end in self.tree.leaves(query @ self.normal[:-1]):
            if far > self.limit * nearest:
                break
            scores.append(self.vectors[begin:end] @ query)
            places.append(self.numbers[begin:end])
            rows += end - begin
            if rows < max(k, seen):
                continue
            best, place = self._top(k, [best, *scores], [place, *places])
            scores, places, seen, rows = [], [], seen + rows, 0
            if len(best) >= k:
                nearest = max(square - 2 * float(best.min()), 0.0)
        return self._top(k, [best, *scores], [place, *places])[1]

    @staticmethod
    def _top(k: int, scores: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        best, place = np.concatenate(scores), np.concatenate(places)
        if len(best) > k:
            top = np.argpartition(best, len(best) - k)[-k:]
            best, place = best[top], place[top]
        return best, place


def neighbours_in(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Up to k nearest of a shard for each query, by exact scores."""
    columns = ["query_id", "vec_id", "score"]
    if not len(data) or not len(queries):
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    shard = Shard(np.stack(data["vector"].to_list()).astype(np.float64), data["ids"].to_list())
    found = []
    for query_id, vector in zip(queries["query_id"].tolist(), queries["vector"], strict=True):
        q = np.asarray(vector, dtype=np.float64)
        place = shard.search(q, k + 1)
        score = (shard.vectors[place] * q).sum(axis=1)
        counts = [len(shard.ids[p]) for p in place]
        ids, scores = np.concatenate([shard.ids[p] for p in place]), np.repeat(score, counts)
        other = ids != query_id
        ids, scores = ids[other], scores[other]
        top = np.lexsort((ids, -scores))[:k]
        found.append(pd.DataFrame({"query_id": np.full(len(top), query_id), "vec_id": ids[top], "score": scores[top]}))
    return pd.concat(found)[columns]


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Per query of ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score of its k nearest found."""
    fit = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    fit = fit.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("vector"))
    asked = fit.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    count, queries = fit.count(), asked.count()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-queries // query_rows))
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = fit.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    points = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    dealt = points.select(
        F.size("vector").alias("width"),
        F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vector",
        "ids",
    )
    spread = asked.select(
        F.size("vector").alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id",
        "vector",
    )
    cell = ["width", "shard", "block"]
    found = dealt.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInPandas(
        lambda data, asking: neighbours_in(data, asking, k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
