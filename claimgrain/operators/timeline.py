"""As-of joins and running counts along time, for keys of any size.

Rows are range-sorted by (key, time) and written, so a key that holds a third of the table lies in
many ranges. Inside a range a window looks back in one pass; what a range needs of those before it
is one row per range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrain.session import stored

_FROM_START = (Window.unboundedPreceding, Window.currentRow)


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of (``key``, order), numbered by ``part``; written, so that the numbers hold.
    Rows equal in all of these may stand in several ranges."""
    keys = [F.col("key"), *[F.col(c) for c in order], F.col("tie")]
    return stored(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                  .drop("tie").withColumn("part", F.spark_partition_id()), "ranges")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
               until: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``asof``: the row of ``right`` of its key that is valid at its time.

    That is the last one with ``right_time <= left_time``; of several at one time the largest by all
    its columns. With ``until`` that row counts only before its own ``until`` time (null: for good);
    an older row does not come back when it has run out. ``asof`` is null where nothing is valid, and
    for rows without key or time. Both sides are read once and sorted together; rows of ``left``
    are neither lost nor multiplied, rows of ``right`` without key or time take no part. The columns
    of ``right`` can be put in order (no maps); an empty side leaves ``asof`` null or gives no rows.
    """
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    mine = left.select(F.col(key).alias("key"), F.col(left_time).alias("time"), F.lit(1).alias("side"),
                       whole(left).alias("row"), F.lit(None).cast(whole_type(right)).alias("valid"))
    given = right.select(F.col(key).alias("key"), F.col(right_time).alias("time"), F.lit(0).alias("side"),
                         F.lit(None).cast(whole_type(left)).alias("row"), whole(right).alias("valid"))
    placed = F.col("key").isNotNull() & F.col("time").isNotNull()
    both = _ranged(mine.unionByName(given).filter(placed), ["time", "side", "valid"])
    inside = Window.partitionBy("part", "key").orderBy("time", "side", "valid").rowsBetween(*_FROM_START)
    last = both.withColumn("near", F.last("valid", ignorenulls=True).over(inside)).filter("side = 1")
    ends = both.filter("side = 0").groupBy("key", "part").agg(
        F.max(F.struct("time", "valid")).alias("end"))
    parts = both.select("key", "part").distinct().join(ends, ["key", "part"], "left")
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "part", F.last("end.valid", ignorenulls=True).over(ahead).alias("carried"))
    found = last.join(carried, ["key", "part"]).select("row", "time", F.coalesce("near", "carried").alias("asof"))
    if until is not None:
        end = F.col(f"asof.`{until}`")
        found = found.withColumn("asof", F.when(end.isNull() | (F.col("time") < end), F.col("asof")))
    unplaced = mine.filter(~placed).select("row", F.col("valid").alias("asof"))
    return found.select("row", "asof").unionByName(unplaced).select("row.*", "asof")


def whole_type(df: DataFrame):
    """The struct type of a table's rows, all fields nullable."""
    return df.select(F.when(F.lit(True), F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                     .alias("row")).schema["row"].dataType


def concurrency(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, intervals, peak, conflicts``: how many intervals of a key overlap.

    ``peak`` is the largest number at one time, ``conflicts`` the number of pairs that overlap. An
    interval holds its start and not its end; a null end is open for good. Intervals without key or
    start, or with nothing inside, take no part. A sweep over starts and ends with running sums:
    each start meets those that are open, so pairs are counted and never made.
    """
    rows = intervals.select(F.col(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end")).filter(
        "key IS NOT NULL AND start IS NOT NULL AND (end IS NULL OR start < end)")
    events = rows.select("key", F.explode(F.filter(F.array(
        F.struct(F.col("start").alias("time"), F.lit(1).cast("bigint").alias("step")),
        F.struct(F.col("end").alias("time"), F.lit(-1).cast("bigint").alias("step"))),
        lambda e: e["time"].isNotNull())).alias("e")).select("key", "e.*")
    # equal steps at one time are one row: the running sums see distinct times only
    moves = events.groupBy("key", "time").agg(F.sum(F.when(F.col("step") < 0, F.col("step")).otherwise(0)).alias("ended"),
                                              F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0)).alias("started"))
    moves = _ranged(moves.withColumn("change", F.col("ended") + F.col("started")), ["time"])
    inside = Window.partitionBy("part", "key").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = moves.groupBy("key", "part").agg(F.sum("change").alias("change")).select(
        "key", "part", F.coalesce(F.sum("change").over(ahead), zero).alias("offset"))
    open_before = F.coalesce(F.sum("change").over(inside), zero)
    swept = moves.withColumn("open", open_before).join(offsets, ["key", "part"]).withColumn(
        "open", F.col("offset") + F.col("open") + F.col("ended"))
    n = F.col("started")
    return swept.groupBy("key").agg(
        F.sum(n).alias("intervals"), F.max(F.col("open") + n).alias("peak"),
        F.sum(n * F.col("open") + F.expr("started * (started - 1) div 2")).alias("conflicts")
    ).withColumnRenamed("key", key)
