"""Names in whole texts: one automaton over all names, longest match at word borders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: What may travel to the tasks: names are a dictionary, not a corpus.
MAX_NAMES, MAX_NAME_BYTES = 1_000_000, 64 << 20
SLICE_BYTES = 8 << 20

MENTIONS = "array<struct<start: int, end: int, name: string, canonical: string, ambiguous: boolean>>"


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _inner(text: str, at: int) -> bool:
    """Whether the character at a place belongs to a word."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def longest_matches(automaton, text: str) -> list[tuple[int, int, int]]:
    """``start, end, number`` of the names in a text, from left to right without overlap.

    A name stands at word borders: where it begins or ends with a word character, none stands
    beside it. Of the names at a place the longest counts."""
    low = fold(text)
    found = []
    for last, (number, size) in automaton.iter(low):
        start, end = last + 1 - size, last + 1
        if not (_inner(low, start - 1) and _inner(low, start)) and not (_inner(low, last) and _inner(low, end)):
            found.append((start, -end, number))
    kept, free = [], 0
    for start, end, number in sorted(found):
        if start >= free:
            kept.append((start, -end, number))
            free = -end
    return kept


def find_mentions(texts: DataFrame, names: DataFrame, key: str = "chunk_id",
                  text: str = "content") -> DataFrame:
    """``key, mentions`` for every row of ``texts``: where names stand in the whole text.

    ``names(name, canonical, ambiguous)``; matching ignores case, places count characters from 0 and
    ``end`` is the place after the last. A name given more than once counts with its smallest
    canonical form and as ambiguous. A null text has no mentions; null keys and repeated rows are
    kept, each row on its own; empty names match nothing; no names or an empty table give empty
    lists or no rows. One pass without a shuffle, linear in the text however many names there are.

    The names travel to the tasks: more than a million, or 64 MB, are refused.
    """
    spark = texts.sparkSession
    table = (names.filter("name <> ''").groupBy(F.lower("name").alias("name"))
             .agg(F.min("canonical").alias("canonical"),
                  (F.bool_or("ambiguous") | (F.count_distinct("canonical") > 1)).alias("ambiguous")))
    few = table.limit(MAX_NAMES + 1).toArrow()
    if few.num_rows > MAX_NAMES or few.nbytes > MAX_NAME_BYTES:
        raise ValueError(f"more than {MAX_NAMES} names or {MAX_NAME_BYTES} bytes of them")
    entries = sorted(zip(*(few[c].to_pylist() for c in ("name", "canonical", "ambiguous"))))
    shipped = spark.sparkContext.broadcast(entries)
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()),
                               ("canonical", pa.string()), ("ambiguous", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        known = shipped.value
        automaton = ahocorasick.Automaton()
        for number, (name, _, _) in enumerate(known):
            automaton.add_word(fold(name), (number, len(name)))
        automaton.make_automaton()
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                out = []
                for value in part.column(1).to_pylist():
                    hits = longest_matches(automaton, value) if value and known else []
                    out.append([(a, b, *known[n]) for a, b, n in hits])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["key", "mentions"])

    schema = StructType([StructField("key", rows.schema["key"].dataType),
                         StructField("mentions", StructType.fromDDL(f"m {MENTIONS}")["m"].dataType)])
    return rows.mapInArrow(scan, schema).select(F.col("key").alias(key), "mentions")
