"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package. Partition counts are left to AQE:
# the initial number is high and coalesced at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Deep pages become a distributed sort instead of a driver-side top-k.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "claimgrain", **extra: str) -> SparkSession:
    """A session with the package settings; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors have to share.

    Where that is unset, a master on one machine gets a temporary folder that is removed at the
    end of the process; any other master is an error, as its executors would each write to
    their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="claimgrain-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    For a table read many times by one query: its lineage ends here, so the plan stays small
    and a lost executor costs a re-read instead of the whole history.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` and the table's folder, for one that is removed when a successor stands."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in any store that Spark reads."""
    system, where = _place(spark, path)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def numbered_folders(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    """Number -> path of the folders ``key=number``."""
    system, where = _place(spark, path)
    if not system.exists(where):
        return {}
    names = [entry.getPath().getName() for entry in system.listStatus(where)]
    return {int(name.split("=")[1]): f"{path}/{name}" for name in names if name.startswith(f"{key}=")}


def finished_folders(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    """``numbered_folders`` that a write has finished."""
    system, _ = _place(spark, path)
    return {number: folder for number, folder in numbered_folders(spark, path, key).items()
            if system.exists(_place(spark, f"{folder}/_SUCCESS")[1])}


def remove_folder(spark: SparkSession, path: str) -> None:
    system, where = _place(spark, path)
    system.delete(where, True)
