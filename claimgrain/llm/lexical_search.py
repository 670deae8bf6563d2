"""Ranked lexical search: many queries evaluated together over shared partial scores.

The terms of a block of items are mined for sets that several items share: terms of exactly the
same items first fall together, then pairs of nodes that most items hold in common become nodes of
their own, round by round. The result is a graph in which an item is a sum of few nodes. One pass
over the documents keeps, per document, its length and its counts of the items' terms; a second one
fills, slice by slice, one accumulator row per node (each node once, from its two parents), sums
the rows of every item and keeps the best documents. Only those leave a task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from claimgrain.llm.common import fields, lower_ascii, map_slices, written

#: Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ENTRIES = 1 << 20  # item terms that travel to the tasks at once
BLOCK_BYTES = 16 << 20   # and their bytes
GROUP_ITEMS = 256        # items that share one graph
MINED_NODES = 1024       # nodes looked at when pairs are mined; more are summed without sharing
MINING_ROUNDS = 24
SLICE_CELLS = 4 << 20    # accumulator cells of a slice of documents

_TERM_BYTES = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20
                    for b in range(256))


@dataclass
class SharedSums:
    """Items as sums of nodes. Terms add into ``first`` nodes; node ``n_first + i`` is the sum of
    ``left[i]`` and ``right[i]``, layer by layer."""
    node_of: np.ndarray            # per term of the block: its first node, or -1
    n_first: int
    layers: list[tuple[np.ndarray, np.ndarray]]
    items: list[int]
    parts: list[np.ndarray]        # per item: its nodes

    @property
    def n_nodes(self) -> int:
        return self.n_first + sum(len(left) for left, _ in self.layers)

    def additions(self) -> int:
        """Additions of two rows that one slice takes beyond filling the first nodes."""
        return sum(len(left) for left, _ in self.layers) + sum(len(p) - 1 for p in self.parts)


def share(items: list[int], terms: list[np.ndarray], n_terms: int) -> SharedSums:
    """Mine the sets of terms that the items share; ``terms[i]`` are distinct term numbers."""
    holders: dict[int, list[int]] = defaultdict(list)
    for at, own in enumerate(terms):
        for t in own.tolist():
            holders[t].append(at)
    nodes: dict[tuple[int, ...], int] = {}
    node_of = np.full(n_terms, -1, np.int64)
    for t in sorted(holders):
        node_of[t] = nodes.setdefault(tuple(holders[t]), len(nodes))
    n_first = len(nodes)
    member = [np.zeros(len(items), bool) for _ in nodes]
    for held, node in nodes.items():
        member[node][list(held)] = True
    layers = []
    for _ in range(MINING_ROUNDS):
        support = np.array([m.sum() for m in member])
        picked = np.argsort(-support, kind="stable")[:MINED_NODES]
        picked = np.sort(picked[support[picked] >= 2])
        if len(picked) < 2:
            break
        table = np.stack([member[i] for i in picked]).astype(np.float32)
        common = table @ table.T
        np.fill_diagonal(common, 0)
        best = common.argmax(axis=1)
        at = np.arange(len(picked))
        # nodes that prefer each other; equal counts go to the smaller number, so one pair exists
        pairs = at[(best[best] == at) & (at < best) & (common[at, best] >= 2)]
        if not len(pairs):
            break
        left, right = picked[pairs], picked[best[pairs]]
        for a, b in zip(left, right):
            both = member[a] & member[b]
            member[a], member[b] = member[a] & ~both, member[b] & ~both
            member.append(both)
        layers.append((left, right))
    table = np.stack(member) if member else np.zeros((0, len(items)), bool)
    return SharedSums(node_of, n_first, layers, items,
                      [np.flatnonzero(table[:, at]) for at in range(len(items))])


def accumulate(plan: SharedSums, term: np.ndarray, row: np.ndarray, value: np.ndarray,
               n_rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """``item, scores`` of every item over a slice of documents; ``value`` of a term in a row."""
    node = plan.node_of[term]
    own = node >= 0
    sums = np.zeros((plan.n_nodes, n_rows), np.int64)
    np.add.at(sums, (node[own], row[own]), value[own])
    at = plan.n_first
    for left, right in plan.layers:
        np.add(sums[left], sums[right], out=sums[at:at + len(left)])
        at += len(left)
    for item, parts in zip(plan.items, plan.parts):
        if len(parts):
            yield item, sums[parts].sum(axis=0)


class Best:
    """The ``k`` best documents of one item so far: higher score, then smaller key, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score = np.empty(0, np.int64)
        self.key, self.void = self.score, np.empty(0, bool)

    def add(self, score: np.ndarray, key: np.ndarray, void: np.ndarray) -> None:
        near = np.flatnonzero(score >= self.least)
        if not len(near):
            return
        score = np.concatenate([self.score, score[near]])
        key, void = np.concatenate([self.key, key[near]]), np.concatenate([self.void, void[near]])
        top = np.lexsort((key, void, -score))[:self.k]
        self.score, self.key, self.void = score[top], key[top], void[top]
        if len(top) == self.k:
            self.least = int(self.score[-1])


def item_terms(text: Column) -> Column:
    """The distinct terms of a text as an array."""
    return F.array_distinct(F.filter(F.split(lower_ascii(text), BETWEEN), lambda t: t != ""))


def _blocks(items: DataFrame) -> Iterable[tuple[list, list[list[str]]]]:
    """Item ids with their terms, in blocks of a bounded number of terms and bytes."""
    ids, terms, entries, size = [], [], 0, 0
    for row in items.orderBy("item", "term").toLocalIterator():
        if not ids or row["item"] != ids[-1]:
            if entries >= BLOCK_ENTRIES or size >= BLOCK_BYTES:
                yield ids, terms
                ids, terms, entries, size = [], [], 0, 0
            ids.append(row["item"])
            terms.append([])
        terms[-1].append(row["term"])
        entries, size = entries + 1, size + len(row["term"].encode())
    if ids:
        yield ids, terms


def _counted(shipped):
    """Per document: its number of terms and its counts of the block's terms."""
    loaded: list[dict[bytes, int]] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append({t.encode(): i for i, t in enumerate(shipped.value)})
        known = loaded[0].get
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        lengths, terms, counts, offsets = [], [], [], [0]
        for text in column.to_pylist():
            words = [] if text is None else text.translate(_TERM_BYTES).split()
            lengths.append(len(words))
            for word, count in Counter(words).items():
                number = known(word)
                if number is not None:
                    terms.append(number)
                    counts.append(count)
            offsets.append(len(terms))
        cuts = pa.array(offsets, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("key")), pa.array(lengths, pa.int64()),
             pa.ListArray.from_arrays(cuts, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64()))],
            names=["key", "n", "terms", "counts"])

    return run


def _best_of_part(shipped, k: int, n_docs: int, n_terms: int, id_type: pa.DataType):
    """The best documents of every item within one task, slice by slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, plans = shipped.value
        best = defaultdict(lambda: Best(k))
        rows = max(64, SLICE_CELLS // max([1, *(p.n_nodes for p in plans)]))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                keys, n, terms, counts = (part.column(i) for i in range(4))
                void = keys.is_null().to_numpy(zero_copy_only=False)
                key = keys.fill_null(0).to_numpy(zero_copy_only=False)
                size = terms.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), size)
                term = terms.flatten().to_numpy().astype(np.int64)
                tf = counts.flatten().to_numpy()
                m = 50 + 50 * n.to_numpy() * n_docs // n_terms
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                for plan in plans:
                    for item, score in accumulate(plan, term, row, value, part.num_rows):
                        best[item].add(score, key, void)
        for item, found in best.items():
            number = len(found.score)
            if number:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[item]] * number, id_type),
                     pa.array(found.key, pa.int64(), mask=found.void), pa.array(found.score)],
                    names=["item", "key", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_key: str = "doc_id",
                  item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_key, rank, doc_key, score``: the ``k`` best documents of each item, scores above 0.

    Terms are maximal stretches of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. With N documents that hold a term, L terms in them all, n in one document, df
    documents with a term and tf its occurrences in one: ``w = floor(1000 ln((2N+2) / (2df+1)))``,
    ``m = 50 + 50 n N div L``, and a document's score is the sum of ``w * (10^9 tf div
    (1000 tf + 20 m))`` over the item's distinct terms. Equal scores rank by smaller ``doc_key``
    (an integer), null last.

    Null and blank texts hold no term: such documents and items find nothing. Rows that repeat an
    item id are one item with the terms of all of them, also where the id is null; each row of
    ``docs`` is a document of its own. Other columns are not read; empty tables give no rows.
    Whole texts count, however long; of a document only its counts of the items' terms are written
    to the shared folder. Items travel to the tasks in blocks of 2^20 terms or 16 MB (an item that
    is longer is a block alone), each with one pass over the documents. A task holds one slice of
    accumulators (32 MB) and ``k`` rows per item, and hands on only those.
    """
    spark = docs.sparkSession
    id_field = items.schema[item_key]
    wanted = (items.select(F.col(item_key).alias("item"), F.explode(item_terms(F.col(text))).alias("term"))
              .distinct())
    rows = docs.select(F.col(doc_key).cast("bigint").alias("key"), F.col(text).alias("text"))
    schema = fields(StructField("item", id_field.dataType), "key bigint, score bigint")
    parts = []
    for ids, terms in _blocks(wanted):
        names = sorted({t for own in terms for t in own})
        number = {t: i for i, t in enumerate(names)}
        counted = written(map_slices(rows, _counted(spark.sparkContext.broadcast(names)),
                                     "key bigint, n bigint, terms array<int>, counts array<bigint>"),
                          "terms")
        totals = counted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        frequency = np.zeros(len(names), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(df) + 1)))
                            for df in frequency], np.int64)
        numbers = [np.array([number[t] for t in own], np.int64) for own in terms]
        plans = [share(list(range(a, min(a + GROUP_ITEMS, len(ids)))), numbers[a:a + GROUP_ITEMS], len(names))
                 for a in range(0, len(ids), GROUP_ITEMS)]
        shipped = spark.sparkContext.broadcast((ids, weights, plans))
        parts.append(counted.filter("size(terms) > 0").mapInArrow(
            _best_of_part(shipped, k, totals[0], totals[1], to_arrow_type(id_field.dataType)), schema))
    if not parts:
        return spark.createDataFrame([], schema).select(
            F.col("item").alias(item_key), F.lit(1).alias("rank"), F.col("key").alias(doc_key), "score")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("item").alias(item_key), "rank", F.col("key").alias(doc_key), "score"))
