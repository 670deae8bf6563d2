"""Vector top-k: exact, filtered and approximate.

The score kernel is a numpy block product inside Arrow tasks. Two layouts feed it:

* few queries (checked in number and bytes): their vectors are shipped to every task
  and the corpus is scanned in place. Only k rows per query and task are shuffled.
* more queries: corpus and queries are cut into blocks and every (corpus block, query block)
  pair is one cogroup. Blocks are made by hashing unique ids, so none can grow hot.

Both give the same rows; neither emits query x chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_BROADCAST_QUERIES = 2048
MAX_BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20     # vectors of one block, queries or corpus
ROWS_PER_BLOCK = 50_000
ROWS_PER_BUCKET = 2048
SCORE_SCHEMA = "query_id string, id string, similarity double"
# Scores are compared at nine places, so equal vectors tie whatever block they sit in.
SCORE_PLACES = 9


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column) -> np.ndarray:
    """A list<double> column as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class _TopK:
    """Running best k per query, ties broken by id."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int):
        self.query_ids, self.vectors, self.k = query_ids, _unit(vectors), k
        self.best: list = [None] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, allowed: np.ndarray | None = None) -> None:
        if not len(ids):
            return
        unit = _unit(vectors)
        for start in range(0, len(self.query_ids), 64):
            rows = slice(start, min(start + 64, len(self.query_ids)))
            scores = np.round(self.vectors[rows] @ unit.T, SCORE_PLACES)
            if allowed is not None:
                scores = np.where(allowed[rows], scores, -np.inf)
            # everything at or above the batch's k-th score, so ties are all looked at
            if len(ids) > self.k:
                cut = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            else:
                cut = np.full(scores.shape[0], -np.inf)
            keep = (scores >= np.maximum(cut, self.floor[rows])[:, None]) & (scores > -np.inf)
            for q in np.flatnonzero(keep.any(axis=1)):
                self._merge(start + q, scores[q, keep[q]], ids[keep[q]])

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.best[q] is not None:
            scores = np.concatenate([self.best[q][0], scores])
            ids = np.concatenate([self.best[q][1], ids])
        order = np.lexsort((ids.astype(str), -scores))[: self.k]
        self.best[q] = (scores[order], ids[order])
        if len(order) == self.k:
            self.floor[q] = self.best[q][0][-1]

    def table(self) -> dict:
        out = {"query_id": [], "id": [], "similarity": []}
        for query_id, best in zip(self.query_ids, self.best):
            if best is not None:
                out["query_id"] += [query_id] * len(best[0])
                out["id"] += best[1].tolist()
                out["similarity"] += best[0].tolist()
        return out


_ARROW = pa.schema([("query_id", pa.string()), ("id", pa.string()),
                    ("similarity", pa.float64())])


def _final(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (partial.withColumn("retrieval_rank", F.row_number().over(order))
            .filter(F.col("retrieval_rank") <= k))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, *,
                max_broadcast: int = MAX_BROADCAST_QUERIES, rows_per_block: int | None = None,
                corpus_rows: int | None = None) -> DataFrame:
    """Exact cosine top-k. ``queries(query_id, vector)``, ``corpus(id, vector)``.

    Returns ``query_id, id, similarity, retrieval_rank``; ids are strings, vectors doubles.
    ``corpus_rows``, if known, saves counting the corpus when blocks are needed.
    """
    queries = queries.select(F.col("query_id").cast("string"), "vector")
    corpus = corpus.select(F.col("id").cast("string"), "vector")
    small = queries.limit(max_broadcast + 1).toArrow()
    if small.num_rows <= max_broadcast and small.nbytes <= MAX_BROADCAST_BYTES:
        return _final(_scan(small, corpus, k), k)
    per_block = rows_per_block or max(256, BLOCK_BYTES // max(1, small.nbytes // small.num_rows))
    rows = corpus.count() if corpus_rows is None else corpus_rows
    return _final(_blocks(queries, corpus, k, -(-rows // per_block) or 1, per_block), k)


def _scan(queries: pa.Table, corpus: DataFrame, k: int) -> DataFrame:
    query_ids = np.array(queries["query_id"].to_pylist(), dtype=object)
    vectors = _matrix(queries["vector"]) if len(query_ids) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vectors is None:
            return
        best = _TopK(query_ids, vectors, k)
        for batch in batches:
            best.add(np.array(batch.column(0).to_pylist(), dtype=object), _matrix(batch.column(1)))
        yield pa.RecordBatch.from_pydict(best.table(), schema=_ARROW)

    return corpus.mapInArrow(score, SCORE_SCHEMA)


def _cogroup_topk(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    query_ids = np.array(right["query_id"].to_pylist(), dtype=object)
    if not len(query_ids) or not left.num_rows:
        return _ARROW.empty_table()
    best = _TopK(query_ids, _matrix(right["vector"]), k)
    for batch in left.select(["id", "vector"]).to_batches(max_chunksize=10_000):
        best.add(np.array(batch.column(0).to_pylist(), dtype=object), _matrix(batch.column(1)))
    return pa.Table.from_pydict(best.table(), schema=_ARROW)


def _block(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _blocks(queries: DataFrame, corpus: DataFrame, k: int, n_corpus: int,
            per_block: int) -> DataFrame:
    """Blocked product: every corpus block meets every query block in one task each."""
    n_query = max(1, -(-queries.count() // per_block))
    left = (corpus.withColumn("cb", _block(F.col("id"), n_corpus))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))))
    right = (queries.withColumn("qb", _block(F.col("query_id"), n_query))
             .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_corpus - 1)))))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        return _cogroup_topk(a, b, k)

    return (left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb"))
            .applyInArrow(score, SCORE_SCHEMA))


# ---- approximate search ---------------------------------------------------------------------

def hyperplanes(dimensions: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dimensions))


def signature(vector: Column, planes: np.ndarray) -> Column:
    """Random-hyperplane bucket of a vector: one matrix product per batch."""
    weights = 1 << np.arange(len(planes), dtype=np.int64)

    @F.arrow_udf(LongType())
    def buckets(column: pa.Array) -> pa.Array:
        return pa.array((_matrix(column) @ planes.T >= 0) @ weights, pa.int64())

    return buckets(vector)


def ann_bits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hyperplanes that leave about ``rows_per_bucket`` rows in a bucket, 16 at most."""
    return min(16, max(4, (rows // rows_per_bucket).bit_length()))


def ann_radius(bits: int, cosine: float, recall: float) -> int:
    """Fewest flipped bits within which a neighbour at ``cosine`` is found with probability
    ``recall``: each of its bits differs from the query's with probability angle / pi."""
    p, reached = acos(cosine) / pi, 0.0
    for radius in range(bits):
        reached += comb(bits, radius) * p ** radius * (1 - p) ** (bits - radius)
        if reached >= recall:
            return radius
    return bits


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, *, dimensions: int = 64,
             bits: int | None = None, probe_bits: int | None = None, cosine: float = 0.8,
             recall: float = 0.9, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Approximate top-k: a query scores only buckets within ``probe_bits`` flipped bits.

    ``bits`` follows from the number of corpus rows unless it is given, and ``probe_bits`` from
    ``bits``: a neighbour at ``cosine`` or closer is met with probability ``recall`` at least,
    however large the corpus. Neighbours further away are met less often. With the defaults a
    query looks at 11 of 16 buckets at 4 bits, 93 of 256 at 8, 794 of 4,096 at 12 and 6,885 of
    65,536 at 16.

    Each corpus row lives in one bucket, so a stored corpus can be partitioned by it. A
    bucket is cut into sub-blocks by id hash as its count demands, so a bucket holding a
    third of the corpus is spread over as many tasks as its share needs.
    """
    if bits is None:
        bits = ann_bits(corpus.count())
    if probe_bits is None:
        probe_bits = ann_radius(bits, cosine, recall)
    planes = hyperplanes(dimensions, bits)
    # a table rather than an expression: there are thousands of them at 16 bits
    flips = (queries.sparkSession.range(1 << bits).withColumnRenamed("id", "flip")
             .filter(F.bit_count("flip") <= probe_bits))
    corpus = corpus.select(F.col("id").cast("string"), "vector").withColumn(
        "bucket", signature(F.col("vector"), planes))
    queries = queries.select(F.col("query_id").cast("string"), "vector").withColumn(
        "bucket", signature(F.col("vector"), planes))
    # at most 2^bits rows
    sizes = (corpus.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("cuts")))
    left = (corpus.join(F.broadcast(sizes), "bucket")
            .withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
            .withColumn("qb", F.lit(0)).select("bucket", "cut", "id", "vector"))
    probes = queries.crossJoin(F.broadcast(flips)).select(
        "query_id", "vector", F.col("bucket").bitwiseXOR(F.col("flip")).alias("bucket"))
    right = (probes.join(F.broadcast(sizes), "bucket")
             .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .select("bucket", "cut", "query_id", "vector"))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        return _cogroup_topk(a, b, k)

    partial = (left.groupBy("bucket", "cut").cogroup(right.groupBy("bucket", "cut"))
               .applyInArrow(score, SCORE_SCHEMA))
    return _final(partial, k)


def hydrate(chunks: DataFrame) -> DataFrame:
    """Defaults for missing metadata of retrieved chunks; empty text counts as missing."""
    blank = lambda name: F.nullif(F.col(name), F.lit(""))
    return (chunks
            .withColumn("source_type", F.coalesce(blank("source_type"), F.lit("unknown")))
            .withColumn("source_name", F.coalesce(blank("source_name"), F.lit("Unknown Source")))
            .withColumn("source_url", blank("source_url"))
            .withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit(3)))
            .withColumn("acquired_at", F.coalesce(
                "acquired_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))))
