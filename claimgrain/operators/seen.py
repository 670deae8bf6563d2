"""Deduplication across runs: a stored filter of the hashes seen so far, and the hashes themselves.

Hashes lie in folders by bucket, next to one small bit table per run and bucket. A run asks the bit
tables first; only buckets in which one of its hashes may have been seen are read for the exact
check. A table of a run is written last, under a name of the run, so a run that is lost or repeated
leaves nothing that counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrain.session import finished_folders, stored

BUCKETS = 256
BITS_PER_HASH = 12   # about one unseen hash in 250 passes the filter
PROBES = 6


def _number(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def _spots(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every hash: one row per hash."""
    high, low = (numbers >> np.uint64(32)).astype(np.uint64), numbers & np.uint64(0xFFFFFFFF)
    step = low | np.uint64(1)
    return (high[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _bit_table(rows: pa.Table) -> pa.Table:
    """One row ``bucket, bits`` for the hashes of a bucket."""
    numbers = rows["number"].to_numpy().view(np.uint64)
    size = max(64, 1 << int(len(numbers) * BITS_PER_HASH - 1).bit_length())
    table = np.zeros(size, bool)
    table[_spots(numbers, size).ravel().astype(np.int64)] = True
    return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()),
                     "bits": pa.array([np.packbits(table).tobytes()], pa.binary())})


def _maybe_seen(rows: pa.Table, tables: pa.Table) -> pa.Table:
    """The hashes of a bucket that some bit table of the bucket holds."""
    numbers = rows["number"].to_numpy().view(np.uint64)
    hit = np.zeros(len(numbers), bool)
    for bits in tables["bits"].to_pylist():
        table = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        hit |= table[_spots(numbers, len(table)).astype(np.int64)].all(axis=1)
    return rows.filter(pa.array(hit))


def _runs(spark: SparkSession, path: str, before: int) -> list[int]:
    return sorted(n for n in finished_folders(spark, f"{path}/filter", "run") if n < before)


def maybe_seen(spark: SparkSession, hashes: DataFrame, path: str, run: int) -> DataFrame:
    """``hash, number, bucket`` of the rows of ``hashes`` that the filters of runs before ``run`` hold:
    all that were seen, and about one in 250 others."""
    runs = _runs(spark, path, run)
    if not runs:
        return hashes.limit(0)
    tables = spark.read.schema("bucket int, bits binary").parquet(*[f"{path}/filter/run={n}" for n in runs])
    return (hashes.groupBy("bucket").cogroup(tables.groupBy("bucket"))
            .applyInArrow(_maybe_seen, hashes.schema))


def admit(rows: DataFrame, path: str, run: int, key: str = "content_hash", order: list[str] | None = None,
          buckets: int = BUCKETS) -> DataFrame:
    """The rows whose ``key`` no run before ``run`` has seen, one per key, and remember their keys.

    Of rows that share a key the first by ``order`` (then by all columns) stays; a null key is no
    key, and such rows all stay. A run that is repeated gives the same rows: it looks at earlier runs
    only and overwrites its own tables. Runs are numbered upwards. ``buckets`` is fixed for a store.

    Copies inside the run combine before the shuffle. Keys are spread by hash, so a bucket holds its
    share of the run's distinct keys; the driver learns which buckets have to be read, one number each.
    """
    spark = rows.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = F.struct(*[F.col(f"`{c}`") for c in order or []], F.to_json(row).alias("_all"))
    named = rows.select(F.col(f"`{key}`").cast("string").alias("hash"), row.alias("row"), first.alias("first"))
    own = named.filter("hash IS NOT NULL").groupBy("hash").agg(F.min_by("row", "first").alias("row"))
    own = stored(own.withColumn("number", _number("hash")).withColumn(
        "bucket", F.pmod("number", F.lit(buckets)).cast("int")), "arrived")
    hashes = own.select("hash", "number", "bucket")
    suspects = stored(maybe_seen(spark, hashes, path, run), "suspects")
    touched = [r["bucket"] for r in suspects.select("bucket").distinct().collect()]
    new = own
    if touched:
        known = seen_hashes(spark, path, run).filter(F.col("bucket").isin(touched)).select("hash", "bucket")
        repeats = suspects.select("hash", "bucket").join(known, ["bucket", "hash"], "left_semi")
        new = own.join(repeats.select("hash"), "hash", "left_anti")
    new = stored(new, "admitted")
    (new.select("hash", "bucket").repartition("bucket").sortWithinPartitions("bucket", "hash")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/hashes/run={run}"))
    (new.select("number", "bucket").groupBy("bucket").applyInArrow(_bit_table, "bucket int, bits binary")
     .write.mode("overwrite").parquet(f"{path}/filter/run={run}"))
    keyless = named.filter("hash IS NULL").select("row")
    return new.select("row").unionByName(keyless).select("row.*")


def seen_hashes(spark: SparkSession, path: str, before: int) -> DataFrame:
    """``hash, bucket`` of all keys that runs before ``before`` admitted; a filter on ``bucket``
    reads those folders alone."""
    paths = [f"{path}/hashes/run={n}" for n in _runs(spark, path, before)]
    schema = "hash string, bucket int"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/hashes").parquet(*paths).select("hash", "bucket")
