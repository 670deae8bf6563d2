"""Periodic runs of words, found by internal pattern matching.

A text's words are ranked by dyadic prefixes (2, 4, 8 ... words), which gives the suffix array and,
for a block of ``b`` words, the part of it that holds the block's occurrences. A wavelet tree over
the suffix array answers the range successor: the next occurrence after the block's own place.
Inside a run of period q the occurrences of a block of at least q words are a progression of
difference q, so the first step of the progression is the candidate; common extensions in both
directions, read from the same dyadic ranks, make it a maximal run or refute it.

Blocks of ``b`` words start at every ``max(4, b / 2)``-th word and answer for periods in
``(b / 2, b]`` (``b = 2``: 1 and 2). A run of ``length >= max(6, 4 q)`` holds such a block and its
next occurrence whole, so no run is missed; and the next occurrence of a block that long is at the
smallest period, so no multiple of a period is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import fields, map_slices

#: A run is at least so many words and so many periods long; the block steps rest on these.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SLICE_BYTES = 3 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def dyadic_ranks(codes: np.ndarray):
    """``ranks, blocks, suffixes`` of a sequence whose every end symbol is unique.

    ``ranks[k][i]`` is the place in the suffix array where suffixes with the ``2 ** k`` symbols at
    ``i`` begin. ``blocks`` lists ``(b, starts, low, high)``: aligned starts of blocks of ``b``
    symbols that occur again, with their part of the suffix array.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, sizes)
    active = order[np.repeat(sizes, sizes) > 1]  # in order of their rank
    ranks, blocks, length = [rank], [], 1
    while len(active):
        old = rank[active].astype(np.int64)
        follow = rank[active + length]
        by = np.lexsort((follow, old))
        active, old, follow = active[by], old[by], follow[by]
        fresh_class = np.r_[True, old[1:] != old[:-1]]
        fresh = fresh_class | np.r_[True, follow[1:] != follow[:-1]]
        at = np.arange(len(active))
        class_start = np.maximum.accumulate(np.where(fresh_class, at, 0))
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[first, len(active)])
        low = np.repeat(old[first] + first - class_start[first], sizes)
        rank = rank.copy()
        rank[active] = low
        ranks.append(rank)
        length *= 2
        many = np.repeat(sizes, sizes)
        here = (many > 1) & (active % max(4, length // 2) == 0)
        blocks.append((length, active[here], low[here], low[here] + many[here]))
        active = active[many > 1]
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    return ranks, blocks, suffixes


class WaveletTree:
    """Bit levels of a permutation, highest bit first, zeros before ones on every level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one, dtype=np.int32)].astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of ``values[low:high]`` that is ``least`` or more; -1 if there is none.

        The number of smaller values in the range is counted level by level; the value of that
        rank in the range is the answer.
        """
        below = np.zeros(len(low), np.int64)
        left, right = low, high
        for depth, zeros in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - depth)) & 1 == 1
            l0, r0, ones_at = zeros[left], zeros[right], zeros[-1]
            below += np.where(one, r0 - l0, 0)
            left = np.where(one, ones_at + left - l0, l0)
            right = np.where(one, ones_at + right - r0, r0)
        found = (below < high - low) & (least < 1 << self.bits)
        rank, left, right = below[found], low[found], high[found]
        value = np.zeros(len(rank), np.int64)
        for depth, zeros in enumerate(self.zeros):
            l0, r0, ones_at = zeros[left], zeros[right], zeros[-1]
            one = rank >= r0 - l0
            value |= np.where(one, 1 << (self.bits - 1 - depth), 0)
            rank = np.where(one, rank - (r0 - l0), rank)
            left = np.where(one, ones_at + left - l0, l0)
            right = np.where(one, ones_at + right - r0, r0)
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def _extension(ranks: list[np.ndarray], at: np.ndarray, other: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols agree from ``at`` and ``other`` on, or before them (``at < other``)."""
    agreed = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        if back:
            a, b = at - agreed - step, other - agreed - step
            same = (a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(b, 0)])
        else:
            same = ranks[k][at + agreed] == ranks[k][other + agreed]
        agreed += np.where(same, step, 0)
    return agreed


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of a sequence whose end symbols are unique, by start,
    then period."""
    ranks, blocks, suffixes = dyadic_ranks(codes)
    starts, periods = [], []
    tree = WaveletTree(suffixes) if any(len(b[1]) for b in blocks) else None
    for length, at, low, high in blocks:
        if not len(at):
            continue
        step = tree.successor(low, high, at + 1) - at
        fits = (step > 0) & (step <= length) & ((step > length // 2) | (length == 2))
        starts.append(at[fits])
        periods.append(step[fits])
    if not starts:
        return (np.empty(0, np.int64),) * 3
    at, period = np.concatenate(starts).astype(np.int64), np.concatenate(periods)
    start = at - _extension(ranks, at, at + period, back=True)
    end = at + period + _extension(ranks, at, at + period, back=False)
    whole = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.unique(np.stack([start[whole], period[whole], end[whole]]), axis=1)
    return found[0], found[2] - found[0], found[1]


def _runs_of_slice(text: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        # the ASCII blanks that bytes.split() knows are those of [\x20\x09-\x0D]
        words = [b"" if t is None else t for t in column.to_pylist()]
        words = [t.split() for t in words]
        counts = np.array([len(w) for w in words], np.int64)
        begins = np.concatenate([[0], np.cumsum(counts + 1)])
        number: dict[bytes, int] = {}
        codes = np.zeros(begins[-1], np.int64)  # 0: the end of a text
        for begin, own in zip(begins.tolist(), words):
            codes[begin:begin + len(own)] = [number.setdefault(w, len(number) + 1) for w in own]
        codes += np.repeat(np.arange(len(words)) * (len(number) + 1), counts + 1)
        start, length, period = find_runs(codes)
        row = np.searchsorted(begins, start, side="right") - 1
        offsets = np.searchsorted(row, np.arange(len(words) + 1))
        inside = np.zeros(len(codes) + 1, np.int32)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, start + length, -1)
        kept = np.cumsum(inside[:-1]) == 0
        collapsed = []
        for i, own in enumerate(words):
            if offsets[i] != offsets[i + 1]:
                own = [w for w, k in zip(own, kept[begins[i]:begins[i + 1] - 1].tolist()) if k]
            collapsed.append(b" ".join(own))
        spans = pa.StructArray.from_arrays(
            [pa.array(start - begins[row], pa.int64()), pa.array(length, pa.int64()),
             pa.array(period, pa.int64())], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text]
        return pa.RecordBatch.from_arrays(
            [*rest, pa.array(counts, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=[n for n in batch.schema.names if n != text] + ["n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed`` of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds ``start, length, period`` of
    every maximal stretch of ``max(6, 4 * period)`` words or more, ``period`` its smallest, by start,
    then period. ``collapsed`` joins by one blank the words that no run holds after its first period.

    A null or blank text has no words, no runs and an empty ``collapsed``. Null keys and repeated
    rows are kept, each row on its own; other columns are not read; an empty table gives no rows.
    Nothing is shuffled. A task works on one slice of texts at a time, in memory that follows the
    slice or the one text that is longer (about 250 bytes a word); time follows words times the
    logarithm of the longest repeat.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = fields(rows.schema["key"], f"n_words bigint, runs {RUNS}, collapsed string")
    found = map_slices(rows, _runs_of_slice("text"), schema, SLICE_BYTES)
    return found.select(F.col("key").alias(key), "n_words", "runs", "collapsed")
