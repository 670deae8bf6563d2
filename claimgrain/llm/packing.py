"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces are taken by size class, largest first. A round range-sorts the class's pieces together with
the open gaps, largest first, and sweeps: a gap is put on a stack, a piece takes the gap on top,
which is the smallest that holds it and is not taken yet. Tasks sweep their own range; what they
leave over (pieces that met no gap, gaps that met no piece) is matched across ranges by rank, from
one count of either kind per range. Pieces without a gap open sequences of their own, as many
neighbours to one as surely fit. Then the gaps are updated and the next round begins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimgrain.llm import bpe
from claimgrain.llm.common import erase, fields, map_slices, written, written_at

PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary>>"
#: Upper ends of the size classes as shares of the capacity; a class ends where the next begins.
CLASSES = (1, 1 / 2, 1 / 3, 1 / 4, 1 / 6, 1 / 8, 1 / 12, 1 / 16, 1 / 24, 1 / 32, 1 / 48, 1 / 64, 1 / 128, 1 / 256)


# ---- texts to pieces ----------------------------------------------------------------------
def ranks_in_order(spec: str) -> bool:
    """Whether the merges of a vocabulary file make tokens of ascending ids, so that the smallest
    id is the smallest rank."""
    model = json.loads(spec)["model"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:]))


class Encoder:
    """Token ids of texts by the compiled encoder, over the vocabulary of a tokenizer file."""

    def __init__(self, spec: str):
        self.spec, self.plain = spec, None
        data = json.loads(spec)
        byte_of = {letter: b for b, letter in enumerate(bpe._byte_letters())}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): number
                 for token, number in data["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=bpe.PATTERN, mergeable_ranks=ranks,
                                      special_tokens=special) if ranks_in_order(spec) else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:
                pass  # a stretch of blanks beyond the reach of the compiled pattern
        self.plain = self.plain or bpe.Vocabulary(self.spec)
        return np.frombuffer(self.plain.encode(text), "<u4")


def _cut(shipped, limit: int, end_id: int, with_ids: bool):
    loaded: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(Encoder(shipped.value))
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            ids = np.append(loaded[0].encode(text), np.uint32(end_id)).astype("<u4")
            head = len(ids) % limit or limit
            cuts = [0, *range(head, len(ids) + 1, limit)]
            parts = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            out.append([(i, a, len(p) // 4, zlib.crc32(p), p if with_ids else None)
                        for i, (a, p) in enumerate(zip(cuts, parts))])
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                   ("ids_crc32", pa.int64()), ("ids", pa.binary())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("key")), pa.array(out, kind)], names=["key", "pieces"])

    return run


def token_pieces(docs: DataFrame, spec: str, limit: int = 1024, end_id: int = 2, key: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, ids``: every text's token ids and ``end_id`` behind
    them, in pieces of ``limit`` ids; only the first piece of a text may be shorter.

    ``spec`` is the text of a byte-level BPE file (``bpe.vocabulary_text``); special tokens written
    in a text become their ids. ``ids`` packs a piece's ids as little-endian unsigned 32-bit
    integers, or is null without ``with_ids``. A null or empty text is the end id alone. Null keys
    and repeated rows are kept; other columns are not read; an empty table gives no rows. Nothing is
    shuffled; a task holds one slice of texts, or the one text that is longer.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = map_slices(rows, _cut(shipped, limit, end_id, with_ids),
                     fields(rows.schema["key"], f"pieces {PIECES}"))
    return cut.select(F.col("key").alias(key), F.inline("pieces"))


# ---- rounds -------------------------------------------------------------------------------
def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, largest first: ``id, piece, size, gap`` (the gap a piece took), and for what is
    left over ``place``: a piece's number among them, or the room on the stack above a gap."""
    names = ["id", "is_piece", "size", "gap", "room", "place", "part"]
    stack, left, part = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(4)[0].as_py()
        took, places, keep = [], [], []
        ids, kinds, rooms = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for at, (name, is_piece, room) in enumerate(zip(ids, kinds, rooms)):
            if not is_piece:
                stack.append([name, room])
                continue
            keep.append(at)
            if stack:
                top = stack[-1]
                took.append(top[0])
                places.append(None)
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            else:
                took.append(None)
                places.append(left)
                left += 1
        if keep:
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), own.column(2), pa.array(took, pa.int64()), own.column(3),
                 pa.array(places, pa.int64()), own.column(4)], names=names)
    above = 0
    for start in range(len(stack), 0, -65536):
        some = stack[max(0, start - 65536):start][::-1]
        rooms = np.array([room for _, room in some], np.int64)
        n = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name for name, _ in some], pa.int64()), pa.array([False] * n), pa.nulls(n, pa.int64()),
             pa.nulls(n, pa.int64()), pa.array(rooms), pa.array(above + np.cumsum(rooms) - rooms),
             pa.array([part] * n, pa.int32())], names=names)
        above += int(rooms.sum())


def match_ranges(counts: list[tuple[int, int, int]]):
    """Match what ranges left over, from ``(part, pieces, room)`` in order of size.

    ``crossed``: pieces ``first .. last - 1`` of ``part`` take the places from ``place`` on of the
    stack of ``other``; ``opened``: pieces of ``part`` from ``first`` on find no gap and are
    numbered from ``number``; ``used``: places taken of each part's stack.
    """
    crossed, opened, used, stack, number = [], [], {}, [], 0
    for part, pieces, room in counts:
        first = 0
        while first < pieces and stack:
            other, free = stack[-1]
            taken = min(pieces - first, free)
            crossed.append((part, first, first + taken, other, used.get(other, 0)))
            used[other] = used.get(other, 0) + taken
            first += taken
            if taken == free:
                stack.pop()
            else:
                stack[-1][1] -= taken
        if first < pieces:
            opened.append((part, first, number))
            number += pieces - first
        if room:
            stack.append([part, room])
    return crossed, opened, used


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows per range as a local table, made without Python workers."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table(dict(zip(kinds.names, map(list, zip(*rows))))), kinds)


def _round(pieces: DataFrame, gaps: DataFrame, largest: int, per_sequence: int) -> tuple[DataFrame, str]:
    """``id, gap, size`` of a class's pieces, and the folder of the sweep they are read from."""
    spark = pieces.sparkSession
    room = F.greatest(F.lit(1), F.expr(f"gap div {largest}"))
    events = (pieces.select("id", F.lit(True).alias("is_piece"), "size", F.lit(1).cast("bigint").alias("room"))
              .unionByName(gaps.select(F.col("gap_id").alias("id"), F.lit(False).alias("is_piece"),
                                       F.col("gap").alias("size"), room.alias("room"))))
    order = [F.desc("size"), F.asc("is_piece"), F.asc("id")]
    swept, path = written_at(
        events.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_sweep, "id bigint, is_piece boolean, size bigint, gap bigint, room bigint, "
                            "place bigint, part int"), "sweep")
    left = swept.filter("gap IS NULL")
    counts = (left.groupBy("part").agg(F.count_if("is_piece").alias("pieces"),
                                       F.sum(F.when(~F.col("is_piece"), F.col("room")).otherwise(0)).alias("room"))
              .orderBy("part").collect())
    crossed, opened, used = match_ranges([tuple(r) for r in counts])
    placed = swept.filter("is_piece AND gap IS NOT NULL").select("id", "gap", "size")
    alone = left.filter("is_piece").select("id", "size", "place", "part")
    if crossed:
        moves = _small(spark, crossed, "part int, first bigint, last bigint, other int, at bigint")
        reach = _small(spark, list(used.items()), "other int, used bigint")
        # one row per pair of ranges; a place of a stack is taken by one piece
        wants = (alone.join(F.broadcast(moves), "part").filter("place >= first AND place < last")
                 .select("id", "size", "other", (F.col("at") + F.col("place") - F.col("first")).alias("spot")))
        offers = (left.filter("NOT is_piece").select(F.col("id").alias("gap"), F.col("part").alias("other"), "place", "room")
                  .join(F.broadcast(reach), "other").filter("place < used")
                  .select("gap", "other", F.explode(F.expr(
                      "sequence(place, least(place + room, used) - 1)")).alias("spot")))
        placed = placed.unionByName(wants.join(offers, ["other", "spot"]).select("id", "gap", "size"))
    if opened:
        fresh = _small(spark, opened, "part int, first bigint, number bigint")
        new = (alone.join(F.broadcast(fresh), "part").filter("place >= first")
               .select("id", "size", (F.col("number") + F.col("place") - F.col("first")).alias("nth")))
        if per_sequence == 1:
            new = new.withColumn("gap", F.col("id"))
        else:
            bundle = Window.partitionBy("bundle").orderBy("nth")
            new = (new.withColumn("bundle", F.expr(f"nth div {per_sequence}"))
                   .withColumn("gap", F.first("id").over(bundle)))
        placed = placed.unionByName(new.select("id", "gap", "size"))
    return placed, path


def best_fit(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``id, sequence_id, offset`` of pieces ``id, length`` packed into sequences of ``capacity``.

    ``id`` is a distinct long without nulls, ``length`` from 1 to ``capacity``; both are read more
    than once, so ``pieces`` is a stored table. A sequence is named after the piece that opened it;
    offsets are gapless from 0. Equal lengths are taken by smaller id. An empty table gives no rows.

    The driver holds the classes' counts and two counts per range of a sweep; a task holds the gaps
    of its own range. A third of all pieces of one length are many ranges, as ids break their ties.
    """
    spark = pieces.sparkSession
    rows = pieces.select("id", F.col("length").alias("size"))
    tops = sorted({max(1, int(capacity * c)) for c in CLASSES}, reverse=True)
    classes = list(zip(tops, [*tops[1:], 0]))
    wide = F.coalesce(*[F.when(F.col("size") > low, i) for i, (_, low) in enumerate(classes)])
    present = {r["class"] for r in rows.groupBy(wide.alias("class")).count().collect()}
    placed, gaps, gaps_at = [], None, None
    for at, (top, low) in enumerate(classes):
        if at not in present:
            continue
        own = rows.filter((F.col("size") > low) & (F.col("size") <= top))
        swept_at = None
        if at == 0:  # no two of them fit together
            done = own.select("id", F.col("id").alias("gap"), "size")
        else:
            open_gaps = gaps.filter(F.col("gap") > low) if gaps is not None else rows.limit(0).select(
                F.col("id").alias("gap_id"), F.col("size").alias("gap"))
            done, swept_at = _round(own, open_gaps, top, capacity // top)
        done = written(done.withColumn("turn", F.lit(at)), "placed")
        placed.append(done)
        if swept_at:
            erase(spark, swept_at)
        change = done.select(F.col("gap").alias("gap_id"), (F.when(
            F.col("id") == F.col("gap"), F.lit(capacity)).otherwise(0) - F.col("size")).alias("gap"))
        if gaps is not None:
            change = change.unionByName(gaps)
        last_at = gaps_at
        left = change.groupBy("gap_id").agg(F.sum("gap").alias("gap")).filter("gap > 0")
        gaps, gaps_at = written_at(left, "gaps")
        if last_at:
            erase(spark, last_at)
    if not placed:
        return rows.select("id", F.col("id").alias("sequence_id"), F.col("size").alias("offset")).limit(0)
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    order = Window.partitionBy("gap").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, 0)
    return whole.select("id", F.col("gap").alias("sequence_id"),
                        (F.sum("size").over(order) - F.col("size")).alias("offset"))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (a ``length`` column and any others) with ``sequence_id`` and ``offset``.

    Pieces without a length, or with one outside 1 to ``capacity``, are an error of the caller and
    raise one when the rows are made."""
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit("a piece is empty or longer than a sequence")).cast("bigint"))
    row = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")
    numbered = written(pieces.select(F.monotonically_increasing_id().alias("id"), checked.alias("length"), row),
                       "pieces")
    return (numbered.select("id", "row").join(best_fit(numbered.select("id", "length"), capacity), "id")
            .select("row.*", "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of packed pieces with their ``ids``: the training sequences.

    A sequence is at most ``capacity`` ids, so no group grows with the table."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
            .select("sequence_id", "length", joined.alias("ids")))
