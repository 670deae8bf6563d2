"""Exact top-k inner products with a KD-tree per shard.

Rows are spread over shards of bounded size. Each shard builds a tree by median splits and
keeps a tight bounding box per node. A query is first answered in one shard, which gives it a
k-th score; with that bound it visits all other shards, best node first, leaving out every box
whose bound is below the k-th score so far.
"""

from __future__ import annotations

import heapq
import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 2048
LEAF_ROWS = 256
#: Largest sum of products that float64 adds up exactly.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1  # scores stop here on both sides


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad),
                      F.lit(False))


def grid(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` per component as double. ``floor`` gives a long, so it is left out
    where doubles have no fraction anyway; overflow stops at the largest double."""
    def cell(x: Column) -> Column:
        scaled = F.greatest(F.least(x.cast("double") * scale, F.lit(sys.float_info.max)),
                            F.lit(-sys.float_info.max))
        return F.when(F.abs(scaled) >= EXACT, scaled).otherwise(F.floor(scaled).cast("double"))

    return F.transform(vector, cell)


class Tree:
    """Median splits on the widest dimension; ``nodes`` hold (low, high, children or rows)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.lows: list = []
        self.highs: list = []
        self.parts: list = []
        self._add(np.arange(len(ids)))

    def _add(self, rows: np.ndarray) -> int:
        points, number = self.points[rows], len(self.parts)
        low, high = points.min(axis=0), points.max(axis=0)
        self.lows.append(low)
        self.highs.append(high)
        self.parts.append(rows)
        spread = high - low
        if len(rows) > LEAF_ROWS and spread.max() > 0:
            half = len(rows) // 2
            order = np.argpartition(points[:, int(np.argmax(spread))], half)
            self.parts[number] = (self._add(rows[order[:half]]), self._add(rows[order[half:]]))
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product any point of each node's box can have with each query."""
        lows, highs = np.array(self.lows), np.array(self.highs)
        return np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int,
               floor: float) -> list[tuple]:
        """The k best ``(score, -id)`` at or above ``floor``, without the row ``own``."""
        best: list[tuple] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = max(floor, best[0][0] if len(best) == k else -math.inf)
            if -bound < kth:
                break  # no box left can reach the k-th score; equal ones may hold a smaller id
            part = self.parts[node]
            if isinstance(part, tuple):
                for child in part:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = self.points[part] @ query
            for i in np.flatnonzero(scores >= kth):
                row = (scores[i], -int(self.ids[part[i]]))
                if -row[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _search(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            points, asked = _matrix(rows["vector"]), _matrix(queries["q_vector"])
            limit = np.abs(points).max() * np.abs(asked).max() * points.shape[1]
            if limit >= EXACT:  # whole numbers of any size, slower
                points = np.array([[int(x) for x in p] for p in points], dtype=object)
                asked = np.array([[int(x) for x in p] for p in asked], dtype=object)
            tree = Tree(rows["id"].to_numpy(), points)
            bounds = tree.bounds(asked)
            # whole numbers, as a double can lie above the k-th score; the lowest stands for none
            floors = [f if f > -LARGEST else -math.inf for f in queries["q_floor"].tolist()]
            for own, query, bound, floor in zip(queries["q_id"].tolist(), asked, bounds, floors):
                out += [(own, -i, max(-LARGEST, min(LARGEST, int(s)))) for s, i in tree.search(own, query, bound, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
               vector: str = "embedding", rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``query_id, rank, key, score``: the k rows with the largest integer inner product.

    ``is_query`` marks the rows that ask; every row but the query's own can answer. Ties go to
    the smaller key. Components count as ``floor(256 * x)``. Vectors that are null, empty or
    hold null or non-finite components take no part, nor do rows with a null key; vectors of
    another length than the query's are no candidates. Rows that repeat a key are candidates
    each, but a row is never its own key's answer. With fewer than k candidates all are given.

    Shards and query blocks are dealt out by hash of the key, so copies of one vector spread.
    Every (shard, query block) pair is one task's group: at most ``rows_per_shard`` and
    ``QUERIES_PER_BLOCK`` rows on average. Only k rows per query and shard are shuffled.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = (rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
            .select("id", grid(F.col("v")).alias("vector"), "asks")
            .withColumn("width", F.size("vector")))
    n = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = -(-n[0] // rows_per_shard) or 1, -(-n[1] // QUERIES_PER_BLOCK) or 1
    deal = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    base = rows.withColumn("shard", deal(1, shards))
    asked = base.filter("asks").withColumn("block", deal(2, blocks))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    group = ["width", "shard", "block"]
    schema = "query_id long, id long, score long"

    def searched(queries: DataFrame) -> DataFrame:
        corpus = base.select("width", "shard", every(blocks).alias("block"), "id", "vector")
        # both sides come from one table: new names keep their columns apart
        own = queries.select(*[F.col(c).alias(f"q_{c}") for c in [*group, "id", "vector", "floor"]])
        return (corpus.groupBy(*group).cogroup(own.groupBy(*[f"q_{c}" for c in group]))
                .applyInPandas(lambda a, b: _search(k)(a, b), schema))

    nothing = F.lit(-LARGEST)
    # each query in its own shard first: its k-th score there bounds it everywhere
    home = searched(asked.select(*group, "id", "vector", nothing.alias("floor")))
    kth = (_best(home, k).groupBy("query_id")
           .agg(F.when(F.count("*") == k, F.min("score")).alias("floor")))
    bounded = asked.drop("shard").join(kth.withColumnRenamed("query_id", "id"), "id", "left").select(
        "width", every(shards).alias("shard"), "block", "id", "vector",
        F.coalesce("floor", nothing).alias("floor"))
    return _best(searched(bounded), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
