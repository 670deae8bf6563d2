"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from claimgrain.session import work_folder

#: Fixed value: the blanks between words, as in ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder of ``spark.checkpoint.dir``.

    Cuts lineage: a lost executor costs a re-read, and rows whose making depends on the run
    (sampled ranges) are made once.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` and the table's folder, for one that is erased when a successor stands."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def erase(spark: SparkSession, path: str) -> None:
    """Remove a table of the work folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark removes the shuffle files of finished steps once
    nothing refers to them, which in a job of many steps can come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(*parts: StructField | str) -> StructType:
    """A schema of existing fields, whatever their names and types, and new ones as DDL."""
    out: list[StructField] = []
    for part in parts:
        out += StructType.fromDDL(part).fields if isinstance(part, str) else [part]
    return StructType(out)


def map_slices(df: DataFrame, fn, schema, max_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over slices of at most about ``max_bytes`` (one row at least).

    ``fn(batch)`` gets a record batch and returns one; memory per task is then bounded by
    the slice and not by the number of rows Spark puts into a batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                yield fn(batch.slice(start, step))
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
