"""Jaccard self-join on word shingles by prefix filters under several token orders.

A document's tokens are its distinct word shingles, as 64-bit fingerprints. Two sets with a
Jaccard similarity of t or more share a token among the first ``n - ceil(t n) + 1`` of each,
whatever global order the tokens stand in. So candidates meet in the prefixes under a first
order, then must also share prefix tokens under a second and a third one, and lie near enough in
a parity sketch; only then their whole sets are compared.

Orders put tokens known to be frequent last, so a passage that many documents hold stays out of
their prefixes, and shingles of long words before those of short ones, which meet by chance the
more often the larger the corpus is. Within that they follow a random hash, another for each
order.

Copies are one class. Inside a token's bucket the members first meet one pivot, and what links
becomes one component; only pairs of different components are looked at after that. So a large
family of near copies costs its size and not its square, and no link between components is lost.
Of such a pair one document holds the token among its first few, which the smaller set of a linked
pair does, and the join key says so: a wording that thousands of pages share, behind words of their
own, makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import erase, fields, map_slices, release, written, written_at
from claimgrain.llm.components import components_at

SHINGLE = 3
PERCENT = 90           # links have 100 * intersection >= 90 * union
MEMO_WORDS = 100_000   # word fingerprints remembered per task
LEVEL_SLOTS = 1 << 22  # bytes of the level table that every task gets, whatever the corpus
SLICE = 16 << 20       # bytes of text that give one batch
PART = 1 << 20         # bytes of those that are strings and words at once
PIVOT_BUCKET = 10      # frequent tokens are cut into buckets of about 2^10 members
ORDER_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SKETCH = 8             # longs of the parity sketch
MAX_BITMAP = 1 << 27   # bits of the bitmap of wanted documents (16 MB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word -> 56 bits of its hash and, in the lowest eight bits, its length (255 at most)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & ~0xFF | min(len(word), 255)
        return value


def shingle_sets(texts: list[str | None], memo: _Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text: 60 bits of hash below four bits for
    the length of the shingle.

    ``bytes.lower`` and ``bytes.split`` touch A-Z and the blanks 0x20, 0x09-0x0D alone. With
    fewer than ``size`` words, the whole sequence is the one token."""
    out, none = [], np.empty(0, np.uint64)
    factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for text in texts:
        words = text.encode().lower().split() if text else []
        n = len(words)
        if not n:
            out.append(none)
            continue
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        width = min(n, size)
        total = np.full(n - width + 1, width, np.uint64)
        length = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            part = hashes[i:n - width + 1 + i]
            total += part * factors[i]
            length += part & np.uint64(0xFF)
        rank = np.minimum(length // np.uint64(width), np.uint64(15))
        out.append(np.unique(_mix(total) >> np.uint64(4) | rank << np.uint64(60)))
    return out


def _sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of a column; only a part of it stands as Python strings at a time."""
    memo, step = _Words(), max(1, int(len(texts) * PART / max(texts.nbytes, 1)))
    for start in range(0, len(texts), step):
        yield from shingle_sets(texts.slice(start, step).to_pylist(), memo, size)


def _frequent(rows: DataFrame, size: int) -> DataFrame:
    """``token, seen``: tokens that stand in two documents or more of one slice of texts.

    A token in F documents over S slices meets itself in about F^2 / 2S of them, so tokens in
    more than a few times sqrt(2S) documents are practically always seen; rarer ones only make
    small buckets. Any outcome gives a valid order."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_sets_of(batch.column(1), size))
        tokens, seen = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64),
                                 return_counts=True)
        kept = seen > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[kept].view(np.int64)), pa.array(seen[kept].astype(np.int64))],
            names=["token", "seen"])

    return map_slices(rows, run, "token long, seen long", SLICE)


def _levels(rows: DataFrame, size: int) -> np.ndarray:
    """A fixed table: slot of a token -> log2 of the sightings of the slot's most frequent one.

    The counts cover all documents and are summed in Spark; at most LEVEL_SLOTS numbers reach
    the driver."""
    slot = F.col("token").bitwiseAND(LEVEL_SLOTS - 1)
    found = (_frequent(rows, size).groupBy("token").agg(F.sum("seen").alias("seen"))
             .groupBy(slot.cast("int").alias("slot"))
             .agg(F.floor(F.log2(F.max("seen"))).cast("int").alias("level")).toArrow())
    table = np.zeros(LEVEL_SLOTS, np.uint8)
    table[found.column("slot").to_numpy()] = np.minimum(found.column("level").to_numpy(), 60)
    return table


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def probe_length(n: int, percent: int) -> int:
    return n - _ceil(percent * n, 100) + 1


def index_length(n, percent: int):
    """Prefix that suffices for the smaller set of a pair."""
    return n - _ceil(2 * percent * n, 100 + percent) + 1


def _prefixes(rows: DataFrame, levels, size: int, percent: int) -> DataFrame:
    """One row per document: fingerprint of its set (``c``, ``nk``; the set's size in the upper
    half of ``nk``), parity sketch ``s0..s7``, prefix tokens ``p0`` with bucket salts (-1: none), and the
    prefixes ``p1``, ``p2`` under the other orders as 32-bit hashes.

    A set met before in the slice keeps its fingerprint only: one copy stands for all."""
    names = ["key", "c", "nk", *[f"s{i}" for i in range(SKETCH)], "p0", "salt", "p1", "p2"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        level_of, seen = levels.value, set()
        c, nk, sketches, parts, salts, others = [], [], [], [], [], ([], [])
        blank = [None] * SKETCH
        for tokens in _sets_of(batch.column(1), size):
            n = len(tokens)
            digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
            signed = (digest & (1 << 64) - 1) - (1 << 63)
            c.append(signed)
            nk.append(n << 32 | digest >> 96)
            if not n or (signed, nk[-1]) in seen:
                sketches.append(blank)
                parts.append(None)
                salts.append(None)
                others[0].append(None)
                others[1].append(None)
                continue
            seen.add((signed, nk[-1]))
            bits = np.bincount((_mix(tokens) >> np.uint64(55)).astype(np.int64),
                               minlength=64 * SKETCH) & 1
            sketches.append(np.packbits(bits.astype(bool)).view(np.int64).tolist())
            level = level_of[(tokens & np.uint64(LEVEL_SLOTS - 1)).astype(np.int64)]
            high = (level.astype(np.uint64) << np.uint64(58)
                    | np.uint64(15) - (tokens >> np.uint64(60)) << np.uint64(54))
            length = probe_length(n, percent)
            for number, seed in enumerate(ORDER_SEEDS):
                order = _mix(tokens ^ np.uint64(seed))
                first = np.argsort(high | (order >> np.uint64(10)), kind="stable")[:length]
                if number:
                    others[number - 1].append((order[first] & np.uint64(0xFFFFFFFF))
                                              .astype(np.uint32).view(np.int32))
                else:
                    parts.append(tokens[first].view(np.int64))
                    cut = np.maximum(level[first].astype(np.int64) - PIVOT_BUCKET, 0)
                    salt = (signed & 0xFFFFF) & ((1 << np.minimum(cut, 20)) - 1)
                    salts.append(np.where(cut > 0, salt, -1).astype(np.int32))
        columns = list(zip(*sketches)) or [()] * SKETCH
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(c, pa.int64()), pa.array(nk, pa.int64()),
             *[pa.array(x, pa.int64()) for x in columns], pa.array(parts, longs),
             pa.array(salts, ints), pa.array(others[0], ints), pa.array(others[1], ints)], names=names)

    sketch = ", ".join(f"s{i} long" for i in range(SKETCH))
    return map_slices(rows, run, fields(
        rows.schema["key"], f"c long, nk long, {sketch}, p0 array<long>, salt array<int>, "
                            "p1 array<int>, p2 array<int>"), SLICE)


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, salt, pos, c): repeated members go, tokens of one member go (salt
    -1; a salted bucket has company under other salts), and each other row gets the bucket's
    first member as its pivot: the one with the fewest rarer tokens, which is the least edited
    of a family. A bucket may span batches; one row of it is remembered."""
    names = ["token", "c", "pos", "pivot_c", "pivot_pos"]
    last = pivot = None
    alone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        t, s, c, p = (batch.column(i).to_numpy() for i in range(4))
        prior = [np.concatenate(([x[0] if last is None else last[i]], x[:-1]))
                 for i, x in enumerate((t, s, c))]
        inside = (t == prior[0]) & (s == prior[1])
        again = inside & (c == prior[2])
        if last is None:
            inside[0] = again[0] = False
        last = (t[-1], s[-1], c[-1])
        keep = ~again
        t, s, c, p, inside = (x[keep] for x in (t, s, c, p, inside))
        if not len(t):
            continue
        begin = np.maximum.accumulate(np.where(inside, -1, np.arange(len(t))))
        carried, at = begin < 0, np.maximum(begin, 0)
        own = [np.where(carried, pivot[i] if pivot else 0, x[at]) for i, x in ((1, c), (2, p))]
        shown = inside | (s >= 0)
        shown[begin[inside & ~carried]] = True  # first members that are not alone
        columns = [x[shown] for x in (t, c, p, *own)]
        if alone and carried.any():
            columns = [np.concatenate(([pivot[i]], x)) for i, x in zip((0, 1, 2, 1, 2), columns)]
        if begin[-1] >= 0:
            b = begin[-1]
            pivot, alone = (t[b], c[b], p[b]), b == len(t) - 1 and s[b] < 0
        else:
            alone = alone and not carried.any()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _size_of(nk: Column) -> Column:
    return F.shiftright(nk, 32)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def _index_length(size: Column, percent: int) -> Column:
    """``index_length`` as an expression."""
    return size - F.ceil(size * (2 * percent) / F.lit(100.0 + percent) - 1e-9) + 1


def _may_link(n: Column, m: Column, pos_n: Column, pos_m: Column, first: Column,
              percent: int) -> Column:
    """Sizes near enough, and the shared token lies in the index prefix of the smaller set
    (``first`` breaks ties)."""
    smaller = (n < m) | ((n == m) & first)
    size, pos = F.when(smaller, n).otherwise(m), F.when(smaller, pos_n).otherwise(pos_m)
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & (pos < _index_length(size, percent)))


def _near(a: str, b: str, n: Column, m: Column, percent: int) -> Column:
    """The sketches differ in no more bits than linked sets differ in tokens."""
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
                 for i in range(SKETCH)), F.lit(0))
    return apart <= n + m - _least_overlap(n, m, percent) * 2


def _wanted(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap over hashes of keys: 16 bits per key, MAX_BITMAP at most. Beyond that it fills
    up and more documents than needed are read; none is lost."""
    count = keys.count()
    bits = 1 << min(MAX_BITMAP.bit_length() - 1, max(15, (16 * count).bit_length()))
    bit = F.pmod(F.xxhash64("key"), F.lit(bits)).cast("bigint")
    parts = (keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).cast("int").alias("part"))
             .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("map"))).toArrow()
    table = np.zeros((max(1, bits >> 15), 4096), np.uint8)
    for part, content in zip(parts.column("part").to_pylist(), parts.column("map").to_pylist()):
        table[part] = np.frombuffer(content, np.uint8)
    return table.ravel(), bits


def _sets(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """``key, c, tokens`` (packed) of the documents whose key is wanted; other texts are not cut
    into words."""
    table, bits = _wanted(keys)
    shipped = rows.sparkSession.sparkContext.broadcast(table)
    hashed = rows.filter(F.col("key").isNotNull()).select(
        "key", "text", F.pmod(F.xxhash64("key"), F.lit(bits)).cast("bigint").alias("bit"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = batch.column(2).to_numpy()
        hit = np.flatnonzero(shipped.value[bit >> 3] >> (bit & 7) & 1)
        chosen = batch.take(pa.array(hit))
        sets = [t.tobytes() for t in _sets_of(chosen.column(1), size)]
        c = [(xxhash.xxh3_128_intdigest(t) & (1 << 64) - 1) - (1 << 63) for t in sets]
        return pa.RecordBatch.from_arrays(
            [chosen.column(0), pa.array(c, pa.int64()), pa.array(sets, pa.binary())],
            names=["key", "c", "tokens"])

    return map_slices(hashed, run, fields(rows.schema["key"], "c long, tokens binary"), SLICE)


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, a_c, b, b_c)`` whose whole sets link."""
    spark = rows.sparkSession
    pairs, pairs_at = written_at(pairs, "pairs")
    keys = pairs.select(F.col("a").alias("key")).unionByName(
        pairs.select(F.col("b").alias("key"))).distinct()
    # written as they come; the exchange that drops repeated rows also serves the join
    sets, sets_at = written_at(_sets(rows, keys, size), "sets")
    sets = sets.dropDuplicates(["key", "c"])
    side = lambda name: sets.select(F.col("key").alias(name), F.col("c").alias(f"{name}_c"),
                                    F.col("tokens").alias(f"{name}_tokens"))
    both = (pairs.join(side("b"), ["b", "b_c"]).join(side("a"), ["a", "a_c"])
            .select("a", "b", "a_tokens", "b_tokens"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for one, two in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (one, two))
            shared = len(x) + len(y) - len(np.union1d(x, y))
            good.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = written(map_slices(both, run, fields(both.schema["a"], both.schema["b"])), "links")
    for done in (pairs_at, sets_at):
        erase(spark, done)
    return links


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct
    ``size``-word shingles, A-Z lower-cased; with fewer words the whole sequence is one token.
    ``component_id`` is the smallest key reachable by links. A null or blank text has an empty
    set and links with nothing. A row with a null key gets its size and a null component, and
    links nothing. Rows that repeat a key count as one document. Other columns are not read; an
    empty table gives no rows. Sets are compared as 64-bit fingerprints of their shingles.

    Texts are read three times and never shuffled: for token counts, for prefixes, and for the
    whole sets of documents that are candidates. What is broadcast has a fixed bound: the level
    table (4 MB) and the bitmap of candidates (16 MB).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(_levels(rows, size))
    table = written(_prefixes(rows, levels, size, percent), "prefixes")
    classes = table.filter("key IS NOT NULL AND nk >= 4294967296")  # sets of one token or more
    named = written(classes.groupBy("c", "nk").agg(F.min("key").alias("node")), "classes")

    # buckets of the first order: members, by 64 bits of their fingerprint, and pivots
    # a place is twice its number, plus one behind the index prefix of its set: of a pair that
    # links, the smaller set holds its first shared token in that prefix
    late = (F.col("pos") >= _index_length(_size_of(F.col("nk")), percent)).cast("int")
    spread = (table.filter("p0 IS NOT NULL")
              .select("c", "nk", F.posexplode(F.arrays_zip("p0", "salt")).alias("pos", "t"))
              .select(F.col("t.p0").alias("token"), F.col("t.salt").alias("salt"), "c",
                      (F.col("pos") * 2 + late).cast("int").alias("pos")))
    sorted_rows = spread.repartition("token", "salt").sortWithinPartitions(
        "token", "salt", "pos", "c")
    live, live_at = written_at(sorted_rows.mapInArrow(
        _with_pivots, "token long, c long, pos int, pivot_c long, pivot_pos int"), "buckets")

    # what is known of the members: node, sketch, prefixes of the other orders. Should two
    # sets share c, both come in, and the comparison of whole sets tells them apart.
    release(spark)
    members = live.select("c").distinct()
    known = [F.first(x, ignorenulls=True).alias(x) for x in
             [*[f"s{i}" for i in range(SKETCH)], "p1", "p2"]]
    nodes, nodes_at = written_at(classes.drop("p0", "salt").join(members, "c", "left_semi")
                                 .groupBy("c", "nk").agg(F.min("key").alias("node"), *known), "nodes")

    sketches, prefixes = nodes.drop("p1", "p2"), nodes.select("c", "nk", "p1", "p2")

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs ``(c, pos, other_c, other_pos)`` that pass sizes and places, the sketch and the
        other two orders; the wide prefixes meet only what is left by then."""
        joined = (pairs.join(sketches.alias("x"), "c").join(
            sketches.alias("y"), F.col("other_c") == F.col("y.c")))
        size_x, size_y = _size_of(F.col("x.nk")), _size_of(F.col("y.nk"))
        near = joined.filter(
            (F.col("x.node") != F.col("y.node"))
            & _may_link(size_x, size_y, F.col("pos"), F.col("other_pos"),
                        F.col("x.node") < F.col("y.node"), percent)
            & _near("x", "y", size_x, size_y, percent)).select(
            *[F.col(f"{t}.{n}").alias(f"{t}_{n}") for t in "xy" for n in ("c", "nk", "node")])
        side = lambda t: prefixes.select(F.col("c").alias(f"{t}_c"), F.col("nk").alias(f"{t}_nk"),
                                         F.col("p1").alias(f"{t}1"), F.col("p2").alias(f"{t}2"))
        kept = (near.join(side("x"), ["x_c", "x_nk"]).join(side("y"), ["y_c", "y_nk"])
                .filter(F.arrays_overlap("x1", "y1") & F.arrays_overlap("x2", "y2")))
        ordered = F.col("x_node") < F.col("y_node")
        pick = lambda one, two: F.when(ordered, F.col(one)).otherwise(F.col(two))
        return kept.select(pick("x_node", "y_node").alias("a"), pick("x_c", "y_c").alias("a_c"),
                           pick("y_node", "x_node").alias("b"), pick("y_c", "x_c").alias("b_c")).distinct()

    # of the places two documents share, the first one in each prefix matters
    first_place = lambda rows: rows.groupBy("c", "other_c").agg(
        F.min(F.struct("pos", "other_pos")).alias("p")).select("c", "other_c", "p.*")
    stars = first_place(live.filter("c <> pivot_c AND (pos % 2 = 0 OR pivot_pos % 2 = 0)").select(
        "c", F.expr("pos div 2").cast("int").alias("pos"), F.col("pivot_c").alias("other_c"),
        F.expr("pivot_pos div 2").cast("int").alias("other_pos")))
    tried, tried_at = written_at(filtered(stars), "tried")
    links = _verified(tried, rows, size, percent)
    release(spark)
    joined, joined_at = components_at(links)

    # members of one bucket that are still in different components
    roots = nodes.select("c", "node").join(joined, "node", "left").select(
        "c", "node", F.coalesce("root", "node").alias("root"))
    release(spark)
    placed, placed_at = written_at(live.select("token", "c", "pos").join(roots, "c"), "placed")
    for done in (live_at, joined_at):
        erase(spark, done)
    placed = placed.select("token", "c", F.expr("pos div 2").cast("int").alias("pos"),
                           (F.col("pos") % 2 == 0).alias("early"), "node", "root")
    shares = placed.groupBy("token", "root").agg(F.count("*").alias("n"),
                                                 F.max(F.col("early").cast("int")).alias("early"))
    largest = F.struct("n", "root")
    tokens = (shares.groupBy("token").agg(
        F.count("*").alias("roots"), F.max_by("root", largest).alias("main"), F.sum("early").alias("early_roots"),
        F.max_by("early", largest).alias("early_main"))
        .filter("roots > 1 AND early_roots > 0")
        .select("token", "main", F.expr("early_roots > early_main").alias("early_minor")))
    # of two members one holds the token in its index prefix, and one is outside the token's main
    # component. Members that do not hold it there meet only those that do: the join key says
    # which are meant, and those that nobody asks for are left out.
    mixed = (placed.join(tokens, "token").filter("early OR root <> main OR early_minor").drop("early_minor")
             .join(sketches, ["c", "node"]))
    meant = F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    minor = mixed.filter("root <> main").withColumn("meets", F.explode(meant)).drop("main").alias("x")
    other = mixed.alias("y")
    size_x, size_y = _size_of(F.col("x.nk")), _size_of(F.col("y.nk"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    crossing = minor.join(other, (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.meets") == F.col("y.early"))
        & (F.col("x.root") != F.col("y.root")) & once
        & _may_link(size_x, size_y, F.col("x.pos"), F.col("y.pos"), F.col("x.node") < F.col("y.node"),
                    percent)
        & _near("x", "y", size_x, size_y, percent))).select(
        F.col("x.c").alias("c"), F.col("x.pos").alias("pos"), F.col("y.c").alias("other_c"),
        F.col("y.pos").alias("other_pos"))
    crossing = first_place(crossing)
    fresh = filtered(crossing).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(fresh.select("a", "a_c", "b", "b_c"), rows, size, percent)
    for done in (placed_at, nodes_at, tried_at):
        erase(spark, done)
    release(spark)
    final, _ = components_at(links.unionByName(more))

    by_class = named.join(final, "node", "left").select(
        "c", "nk", F.coalesce("root", "node").alias("component"))
    done = table.select("key", "c", "nk").join(by_class, ["c", "nk"], "left")
    release(spark)
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return done.select(F.col("key").alias(key), _size_of(F.col("nk")).alias("n_shingles"),
                       component.alias("component_id"))
