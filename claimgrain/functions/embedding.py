"""Text vectors by feature hashing.

Each word adds one to the position its MD5 digest names, so vectors are the same on every
engine and run. Counting into 64 positions with array lambdas is far slower than one count
over all words of a batch, so this is one of the few Python steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 64
_REMEMBERED_WORDS = 50_000
SLICE_BYTES = 1 << 20   # of text that is cut into words at once


def slices(column: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """A text column in runs of rows of about ``max_bytes`` or fewer, one row at least."""
    start, size = 0, 0
    for i, length in enumerate(pc.binary_length(column).to_pylist()):
        if size and size + (length or 0) > max_bytes:
            yield column.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    yield column.slice(start)


class _Positions(dict):
    """word -> position, remembered within a batch of texts, up to a bound."""

    def __missing__(self, word: str) -> int:
        position = hashlib.md5(word.encode()).digest()[0] % DIMENSIONS
        if len(self) < _REMEMBERED_WORDS:
            self[word] = position
        return position


def _counts(texts: list[str | None], positions: _Positions) -> np.ndarray:
    words = [value.lower().split() if value else [] for value in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(positions.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    cells = np.repeat(np.arange(len(words)) * DIMENSIONS, lengths) + at
    return np.bincount(cells, minlength=len(words) * DIMENSIONS).astype(np.float64)


@F.arrow_udf(ArrayType(DoubleType()))
def hash_vector(text: pa.Array) -> pa.Array:
    """Word counts by hashed position, unnormalised.

    The words of a slice of texts are held at a time: as strings they take some ten times the
    bytes of their texts."""
    positions, counts = _Positions(), [np.empty(0)]
    for some in slices(text, SLICE_BYTES):
        counts.append(_counts(some.to_pylist(), positions))
    flat = np.concatenate(counts)
    offsets = np.arange(0, flat.size + 1, DIMENSIONS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
