"""A keyed table in versions: every change makes a new one, readers keep the one they pinned.

Rows lie in folders by bucket of their key. A version is a small table of the bucket folders that
belong to it, written after the folders are complete; a change writes only the buckets it touches,
under its own number. A job that dies leaves folders that no version names, and a reader never meets
half a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrain.operators.ingest import upsert
from claimgrain.session import finished_folders, numbered_folders, remove_folder, stored_at

BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(f"`{key}`"), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    return sorted(finished_folders(spark, f"{path}/versions", "version"))


def _layout(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket -> number of the change that wrote it, one entry per bucket."""
    rows = spark.read.schema("bucket int, made int").parquet(f"{path}/versions/version={version}").collect()
    return {r["bucket"]: r["made"] for r in rows}


def _write(rows: DataFrame, path: str, number: int, key: str, buckets: int) -> None:
    (rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/made={number}"))


def _commit(spark: SparkSession, path: str, number: int, layout: dict[int, int]) -> None:
    """Name the buckets of a version; a second writer of the same number fails here."""
    table = spark.createDataFrame(sorted(layout.items()), "bucket int, made int").coalesce(1)
    table.write.mode("error").parquet(f"{path}/versions/version={number}")


def create(base: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Write a table as version 0. Its columns do not include ``bucket``; keys are distinct and not
    null; an empty table is a version without buckets, whose schema is kept."""
    spark = base.sparkSession
    if versions(spark, path):
        raise ValueError(f"{path} holds a table already")
    _write(base, path, 0, key, buckets)
    base.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    present = numbered_folders(spark, f"{path}/rows/made=0", "bucket")
    _commit(spark, path, 0, dict.fromkeys(present, 0))
    return 0


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, the newest by default; ``only`` some of its buckets.

    The folders are fixed when the table is opened, so a reader sees one version however long it
    reads and whatever is written meanwhile."""
    version = versions(spark, path)[-1] if version is None else version
    schema = spark.read.parquet(f"{path}/schema").schema
    folders = [f"{path}/rows/made={made}/bucket={bucket}" for bucket, made in sorted(_layout(spark, path, version).items())
               if only is None or bucket in only]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def change(spark: SparkSession, path: str, changes: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> int:
    """A new version with ``changes`` put in: the latest row per key by ``order`` replaces the row of
    its key or is added. Returns its number.

    Only buckets that hold a changed key are read and written. At most ``buckets`` small numbers reach
    the driver. The changes are made once, into a table of the work folder that goes with the call. Without changes the newest version stays. Writers that start from one version agree on
    the number of the next; the slower one fails when it commits and changes nothing.
    """
    last = versions(spark, path)[-1]
    changes, made_at = stored_at(changes, "changes")
    try:
        touched = sorted(r["b"] for r in changes.select(_bucket(key, buckets).alias("b")).distinct().collect())
        if not touched:
            return last
        _write(upsert(read(spark, path, last, touched), changes, key, order), path, last + 1, key, buckets)
    finally:
        remove_folder(spark, made_at)
    _commit(spark, path, last + 1, _layout(spark, path, last) | {b: last + 1 for b in touched})
    return last + 1


def forget(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Remove the versions before ``keep`` and the rows that none of the others names; readers of
    those versions must be done. Returns the removed versions."""
    every = versions(spark, path)
    used = {(bucket, made) for v in every if v >= keep for bucket, made in _layout(spark, path, v).items()}
    gone = [v for v in every if v < keep]
    dead = {(bucket, made) for v in gone for bucket, made in _layout(spark, path, v).items()} - used
    for v in gone:  # a version goes before its rows do
        remove_folder(spark, f"{path}/versions/version={v}")
    for bucket, made in dead:
        remove_folder(spark, f"{path}/rows/made={made}/bucket={bucket}")
    return gone
