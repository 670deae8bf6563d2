"""Approximate vector top-k over a trained index: coarse cells, product codes, exact re-ranking.

A bounded sample fits the cells (k-means) and, on what is left after a row's cell centre is taken
away, one small codebook per group of dimensions. What is left is divided by the cell's own spread
first, so that rows of a tight cell are told apart as well as rows of a loose one. Every row is then
a cell, a few bytes and its exact product with the centre. A query looks into its nearest cells,
scores the codes there by table look-up, and only its best candidates are scored on their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from claimgrain.operators.retrieval import SCORE_PLACES, _final, _matrix, _unit
from claimgrain.session import stored

TRAINING_ROWS = 65_536    # sample that the quantiser is fitted on, at most
ROWS_PER_CELL = 64        # of that sample, so that centres are means of something
MAX_CELLS = 4096
ROWS_PER_BLOCK = 250_000  # index rows that one task scores together (about 12 MB)
QUERIES_PER_BLOCK = 1_000
QUERIES_AT_ONCE = 32      # of a block, while it is scored
SEGMENT = 16_384          # index rows whose scores are held at once
FIT_ROWS = 8192           # sample rows whose distances to all centres are held at once
CALIBRATION = 256         # sample rows that stand for queries when the probes are chosen


@dataclass
class Quantiser:
    """Unit vectors: ``centres`` (cells x dimensions), ``spread`` (mean distance of a cell's rows from
    its centre), ``books`` (parts x codes x part width) for what is left, in units of the spread."""
    centres: np.ndarray
    spread: np.ndarray
    books: np.ndarray
    probes: int

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells whose centres are nearest to each row, nearest first."""
        n = min(n, len(self.centres))
        own, out = (self.centres ** 2).sum(axis=1), np.empty((len(unit), n), np.int64)
        for at in range(0, len(unit), 1024):  # distances of some rows at a time
            far = own - 2 * unit[at:at + 1024] @ self.centres.T
            top = np.argpartition(far, n - 1, axis=1)[:, :n]
            out[at:at + 1024] = np.take_along_axis(
                top, np.take_along_axis(far, top, 1).argsort(axis=1, kind="stable"), 1)
        return out

    def codes(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = ((unit - self.centres[cells]) / self.spread[cells, None]).reshape(len(unit), parts, width)
        out = np.empty((len(unit), parts), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = ((book ** 2).sum(axis=1) - 2 * rest[:, p] @ book.T).argmin(axis=1)
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Products of queries with all entries of all books (queries x parts x codes)."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", unit.reshape(len(unit), parts, width), self.books)

    def fixed(self, cells: np.ndarray, codes: np.ndarray, along: np.ndarray) -> np.ndarray:
        """The part of a coded row's score that no query changes.

        ``along`` has the exact products of the rows with their centre, so codes only stand for the
        product of what is left of row and query: their error shrinks as both near the centre.
        """
        own = self.tables(self.centres)
        out = along - (self.centres ** 2).sum(axis=1)[cells]
        for p in range(codes.shape[1]):
            out -= self.spread[cells] * own[cells, p, codes[:, p]]
        return out

    def scores(self, unit: np.ndarray, tables: np.ndarray, cell: int, codes: np.ndarray,
               fixed: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries, with their ``tables``, and coded rows of one cell."""
        out = np.zeros((len(unit), len(codes)))
        for p in range(codes.shape[1]):
            out += tables[:, p].take(codes[:, p], axis=1)
        out *= self.spread[cell]
        return out + (unit @ self.centres[cell])[:, None] + fixed[None, :]


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` groups; a group that loses its rows restarts at a far row."""
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own, gap = np.empty(len(rows), np.int64), np.empty(len(rows))
        for at in range(0, len(rows), FIT_ROWS):  # distances of some rows at a time
            some = rows[at:at + FIT_ROWS]
            far = (centres ** 2).sum(axis=1) - 2 * some @ centres.T
            own[at:at + FIT_ROWS] = far.argmin(axis=1)
            gap[at:at + FIT_ROWS] = far.min(axis=1) + (some ** 2).sum(axis=1)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        lost = np.flatnonzero(~full)
        centres[lost] = rows[np.argsort(-gap, kind="stable")[:len(lost)]]
    return centres


def _sample(corpus: DataFrame, n_rows: int, wanted: int) -> np.ndarray:
    """Vectors of the rows with the smallest id hashes: about ``wanted``, the same every time."""
    share = min(1.0, 1.2 * wanted / max(n_rows, 1))
    reach = int(share * (1 << 32))
    number = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    some = corpus.filter(number < reach).select(number.alias("h"), "id", "vector").toArrow()
    order = np.lexsort((np.array(some["id"].to_pylist(), dtype=str), some["h"].to_numpy()))[:wanted]
    return _unit(_matrix(some["vector"].take(pa.array(order))))


def _spread(rows: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Root mean squared distance of each cell's rows from its centre; that of all rows for cells
    whose rows all lie on it, and 1 if all rows of all cells do."""
    far = ((rows - centres[own]) ** 2).sum(axis=1)
    count = np.bincount(own, minlength=len(centres))
    mean = np.bincount(own, weights=far, minlength=len(centres)) / np.maximum(count, 1)
    mean[mean < 1e-18] = far.mean() if far.mean() >= 1e-18 else 1.0
    return np.sqrt(mean)


def train(corpus: DataFrame, *, dimensions: int, parts: int = 16, cells: int | None = None,
          training_rows: int = TRAINING_ROWS, recall: float = 0.97, k: int = 10,
          seed: int = 7) -> Quantiser:
    """Fit cells and codebooks on at most ``training_rows`` rows of ``corpus(id, vector)``.

    There are about ``sqrt(rows)`` cells, 4,096 at most. ``probes`` is the number of nearest cells
    that hold all of the true ``k`` nearest sample rows for the share ``recall`` of some sample rows
    asked as queries; a share of neighbours alone would let one hot group bear all the misses.
    ``parts`` divides ``dimensions``. The sample is all that reaches the driver.
    """
    corpus = corpus.select(F.col("id").cast("string"), "vector").filter("vector IS NOT NULL")
    n_rows = corpus.count()
    if cells is None:
        cells = 1 << max(2, round(np.log2(max(n_rows, 1)) / 2))
    cells = min(cells, MAX_CELLS, max(1, min(n_rows, training_rows) // ROWS_PER_CELL))
    sample = _sample(corpus, n_rows, min(n_rows, training_rows))
    if not len(sample):
        sample = np.zeros((1, dimensions))
    rng = np.random.default_rng(seed)
    centres = k_means(sample, cells, 10, rng)
    found = Quantiser(centres, np.ones(len(centres)), np.zeros((parts, 1, dimensions // parts)), len(centres))
    own = found.nearest(sample, 1)[:, 0]
    found.spread = _spread(sample, centres, own)
    rest = ((sample - centres[own]) / found.spread[own, None]).reshape(len(sample), parts, -1)
    fitted = [k_means(rest[:, p], 256, 8, rng) for p in range(parts)]
    found.books = np.stack(fitted)
    asked = rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-near, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    if true.size:
        order = found.nearest(sample[asked], len(centres))
        place = np.argsort(order, axis=1)  # place of every cell in a query's order
        needed = np.sort(np.take_along_axis(place, own[true], axis=1).max(axis=1))
        found.probes = int(needed[ceil(recall * len(needed)) - 1]) + 1
    return found


def index(corpus: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``id, cell, code, along`` of every row of ``corpus(id, vector)`` that has a vector; one pass, no
    shuffle. ``code`` has one byte per part, ``along`` is the row's product with its cell's centre."""
    shipped = corpus.sparkSession.sparkContext.broadcast(quantiser)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                cells = shipped.value.nearest(unit, 1)[:, 0]
                codes = shipped.value.codes(unit, cells)
                along = (unit * shipped.value.centres[cells]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cells, pa.int32()),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(along)],
                    names=["id", "cell", "code", "along"])

    rows = corpus.select(F.col("id").cast("string").alias("id"), "vector").filter("vector IS NOT NULL")
    return rows.mapInArrow(place, "id string, cell int, code binary, along double")


def cut_cells(indexed: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``cell, cuts``: into how many blocks each cell is cut, one row per cell, for an index that is
    stored by cell."""
    return indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("cuts"))


@F.arrow_udf(DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    return pa.array(np.round((_unit(_matrix(a)) * _unit(_matrix(b))).sum(axis=1), SCORE_PLACES))


def _best(near: np.ndarray, at: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` highest scores of each query with their places, equal scores by rank of the id."""
    if near.shape[1] <= n:
        return near, at
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    cut = np.take_along_axis(near, top, 1).min(axis=1)
    crowded = ((near >= cut[:, None]).sum(axis=1) > n) & (cut > -np.inf)
    for q in np.flatnonzero(crowded):
        tied = np.flatnonzero(near[q] >= cut[q])
        top[q] = tied[np.lexsort((rank[at[q, tied]], -near[q, tied]))[:n]]
    return np.take_along_axis(near, top, 1), np.take_along_axis(at, top, 1)


def _block_topk(rows: pa.Table, asks: pa.Table, quantiser: Quantiser, n: int) -> Iterator[tuple]:
    """``(queries, rows, scores)`` of the ``n`` best rows of a block for some queries at a time, as
    places in ``asks`` and ``rows``. Rows of cells that a query does not probe are not its own."""
    ids = rows["id"].combine_chunks()
    rank = np.empty(len(ids), np.int64)
    rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    cells = rows["cell"].to_numpy()
    place = np.argsort(cells, kind="stable")
    bounds = np.searchsorted(cells[place], np.arange(len(quantiser.centres) + 1))
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
    fixed = quantiser.fixed(cells, codes, rows["along"].to_numpy())[place]
    codes, rank = codes[place], rank[place]
    vectors = _unit(_matrix(asks["vector"]))
    for start in range(0, len(vectors), QUERIES_AT_ONCE):
        unit = vectors[start:start + QUERIES_AT_ONCE]
        tables, probed = quantiser.tables(unit), np.zeros((len(unit), len(quantiser.centres)), bool)
        np.put_along_axis(probed, quantiser.nearest(unit, quantiser.probes), True, axis=1)
        near, at = np.empty((len(unit), 0)), np.empty((len(unit), 0), np.int64)
        held, held_at = [], []
        for cell in np.flatnonzero(probed.any(axis=0) & (bounds[1:] > bounds[:-1])):
            asking = np.flatnonzero(probed[:, cell])
            for low in range(bounds[cell], bounds[cell + 1], SEGMENT):
                some = slice(low, min(low + SEGMENT, bounds[cell + 1]))
                own = np.full((len(unit), some.stop - low), -np.inf)
                own[asking] = quantiser.scores(unit[asking], tables[asking], cell, codes[some], fixed[some])
                held.append(np.where(np.isnan(own), np.inf, own))  # as Spark orders them
                held_at.append(np.arange(low, some.stop))
                if sum(map(len, held_at)) >= SEGMENT:
                    near, at = _merged(near, at, held, held_at, rank, n)
                    held, held_at = [], []
        near, at = _merged(near, at, held, held_at, rank, n)
        who, column = np.nonzero(near > -np.inf)
        yield who + start, place[at[who, column]], near[who, column]


def _merged(near, at, held: list, held_at: list, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of what was best so far and of further rows."""
    new = np.concatenate([np.empty(0, np.int64), *held_at])
    return _best(np.concatenate([near, *held], axis=1),
                 np.concatenate([at, np.broadcast_to(new, (len(at), len(new)))], axis=1), rank, n)


def search(queries: DataFrame, corpus: DataFrame, indexed: DataFrame, quantiser: Quantiser, k: int = 10, *,
           candidates: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Approximate cosine top-k: ``query_id, id, similarity, retrieval_rank``, similarities exact.

    ``queries(query_id, vector)``, ``corpus(id, vector)`` with distinct ids, ``indexed`` as a stored
    table. A query meets the codes of its nearest cells, keeps ``candidates`` rows (32 k) by code
    and ranks those by their vectors; equal similarities rank by id. Null vectors take no part.

    Only codes and candidates are shuffled. Index and queries are cut into blocks by id hash, and each
    pair of blocks is one task, which keeps the best candidates of a query over all its cells: a query
    hands on ``candidates`` rows per block of the index, not per cell. A cell that holds a third of the
    corpus is spread over the blocks like any other.
    """
    candidates = 32 * k if candidates is None else candidates
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(quantiser)
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").filter("vector IS NOT NULL")
    corpus = corpus.select(F.col("id").cast("string").alias("id"), "vector")
    cuts, n_queries = max(1, ceil(indexed.count() / rows_per_block)), queries.count()
    # few blocks of the index leave cores idle unless there are more of queries
    wanted = min(ceil(n_queries / QUERIES_AT_ONCE), ceil(2 * spark.sparkContext.defaultParallelism / cuts))
    parts = max(1, ceil(n_queries / QUERIES_PER_BLOCK), wanted)
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = indexed.withColumn("cut", block("id", cuts)).withColumn("part", every(parts))
    right = queries.withColumn("part", block("query_id", parts)).withColumn("cut", every(cuts))
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("near", pa.float64())])

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asks.num_rows:
            names, ids = (t[c].combine_chunks() for t, c in ((asks, "query_id"), (rows, "id")))
            for who, at, near in _block_topk(rows, asks, shipped.value, candidates):
                found.append(pa.RecordBatch.from_arrays(
                    [names.take(pa.array(who)), ids.take(pa.array(at)), pa.array(near)], schema=schema))
        return pa.Table.from_batches(found, schema=schema)

    found = (left.groupBy("cut", "part").cogroup(right.groupBy("cut", "part"))
             .applyInArrow(score, "query_id string, id string, near double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    kept = (found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= candidates)
            .select("query_id", "id"))
    exact = (kept.join(corpus.withColumnRenamed("vector", "v"), "id").join(queries, "query_id")
             .select("query_id", "id", _cosine("vector", "v").alias("similarity")))
    return _final(exact, k)


def quantised_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, *, dimensions: int = 64,
                   **search_options) -> DataFrame:
    """Train, index and search in one go; a service keeps the quantiser and the stored index."""
    quantiser = train(corpus, dimensions=dimensions, k=k)
    indexed = stored(index(corpus, quantiser), "index")
    return search(queries, corpus, indexed, quantiser, k, **search_options)
