"""Distributed running sums over a global order.

Rows are range-partitioned, each partition is sorted and written once, and the running sum of a
row is the total of the partitions before it plus the sum inside its partition. Only one total
per partition (and group) is brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrain.llm.common import fields, written


def _inside(group: str, size: str):
    """Add ``inside`` and ``nth``: sum of sizes and count of rows before the row in its part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, count = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            groups = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            first = np.empty(n, bool)
            first[0] = last is None or groups[0] != last
            first[1:] = groups[1:] != groups[:-1]
            begin = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            before = np.cumsum(sizes) - sizes
            carried = begin < 0
            at = np.maximum(begin, 0)
            inside = np.where(carried, total + before, before - before[at])
            nth = np.where(carried, count + np.arange(n), np.arange(n) - begin)
            last, total, count = groups[-1], int(inside[-1] + sizes[-1]), int(nth[-1] + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(inside, pa.int64()), pa.array(nth, pa.int64())],
                names=[*batch.schema.names, "inside", "nth"])

    return run


def running_sums(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``before`` and ``position``: the sum of ``size`` and the number of rows
    ahead of each row within its group, in ``order``.

    ``group`` and ``size`` are longs without nulls. The result is unique up to rows equal in
    all order columns; those get consecutive places. A group with most of the rows is cut into
    many ranges. The table is ranged by (group, order, a number of the row), written to the
    shared folder and read back, so both passes see the same parts.
    """
    keys = [group, *order, "_row"]
    ranged = (rows.withColumn("_row", F.monotonically_increasing_id())
              .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
              .withColumn("_part", F.spark_partition_id()))
    schema = fields(*ranged.schema.fields, "inside long, nth long")
    kept = written(ranged.mapInArrow(_inside(group, size), schema), "ranges")
    totals = kept.groupBy(group, "_part").agg(F.sum(size).alias("part_sum"),
                                              F.count("*").alias("part_rows"))
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_part",
                            F.coalesce(F.sum("part_sum").over(ahead), F.lit(0)).alias("off_sum"),
                            F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("off_rows"))
    out = [c for c in rows.columns if c != group]
    return kept.join(offsets, [group, "_part"]).select(
        group, *out, (F.col("off_sum") + F.col("inside")).alias("before"),
        (F.col("off_rows") + F.col("nth")).alias("position"))
