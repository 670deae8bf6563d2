"""Structured Streaming twins of the batch ingest and alert jobs.

A job writes what a trigger made into a folder of its own, overwritten when the trigger is run
again, so a lost executor or driver leaves one copy. What readers see is made from those folders
and equals the batch result in whatever order, and over however many triggers, the rows arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgrain.functions import ids
from claimgrain.operators import audit, ingest
from claimgrain.session import finished_folders, is_folder, remove_folder


def read_table_stream(spark: SparkSession, folder: str, name: str,
                      max_files: int = 1000) -> DataFrame:
    """Stream the files of one table of a shared folder: a folder of part files, as Spark writes
    tables, or one file."""
    path = f"{folder}/{name}.parquet"
    reader = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", max_files))
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a stream until its source is exhausted. An empty batch is written first, so a source
    without rows leaves a table without rows."""
    write(rows.sparkSession.createDataFrame([], rows.schema), -1)
    query = (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def ingest_stream(docs: DataFrame, table: str, checkpoint: str) -> None:
    """Chunk arriving documents into an append-only, batch-numbered chunk log.

    ``current_chunks`` reads the log as a keyed table.
    """
    def write(batch: DataFrame, number: int) -> None:
        docs = ingest.spread(batch, "source_url", "source_name", "acquired_at")
        (ingest.ingest(docs).withColumn("version", F.lit(number).cast("bigint"))
         .write.mode("overwrite").parquet(f"{table}/batch={number}"))

    _drain(docs, write, checkpoint)


def current_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Latest row per chunk id over all batches."""
    log = spark.read.parquet(table).drop("batch")
    return ingest.latest_per_key(log, "chunk_id", "version").drop("version")


# ---- every text once -------------------------------------------------------------------------

_IDENTITY = ["document_id", "source_name", "source_url", "acquired_at", "published_at"]


def text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash under which equal texts of one source type are one."""
    return docs.withColumn("text_key", F.sha2(F.concat_ws(
        "\x1f", F.coalesce("source_type", F.lit("")), F.coalesce("raw_content", F.lit(""))), 256))


def distinct_stream(docs: DataFrame, table: str, checkpoint: str,
                    keep: str = "7 days") -> StreamingQuery:
    """Clean and cut every text once, however often and in whichever trigger it arrives.

    Two logs: ``copies`` has the identity of every document without its text; ``chunks`` the parts
    of every text, made when the stream first meets its key. The keys met are the stream's state;
    a key is forgotten ``keep`` after its arrival (the time of the trigger, so no row counts as
    late and none is dropped), which bounds the state by the keys of that span. A text that comes
    back later is cut again into equal parts, which ``distinct_chunks`` reads once.
    """
    spark = docs.sparkSession
    keyed = text_key(docs if "document_id" in docs.columns else ingest.with_document_ids(docs))

    def write_copies(batch: DataFrame, number: int) -> None:
        (batch.select("text_key", "source_type", *_IDENTITY).dropDuplicates()
         .write.mode("overwrite").parquet(f"{table}/copies/batch={number}"))

    def write_chunks(batch: DataFrame, number: int) -> None:
        rows = ingest.spread(batch, "text_key")
        (ingest.chunk_documents(ingest.clean_documents(rows))
         .select("text_key", "chunk_index", "content", ids.content_hash(F.col("content")).alias("content_hash"))
         .write.mode("overwrite").parquet(f"{table}/chunks/batch={number}"))

    _drain(keyed, write_copies, f"{checkpoint}/copies")
    first = (keyed.select("text_key", "source_type", "raw_content")
             .withColumn("arrived", F.current_timestamp()).withWatermark("arrived", keep)
             .dropDuplicatesWithinWatermark(["text_key"]))
    return _drain(first, write_chunks, f"{checkpoint}/chunks")


def distinct_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of every distinct text, under its first document (by time, then id), with the
    number of documents that hold it.

    Copies combine before the shuffle, so a text that a third of all documents share costs one row
    per task.
    """
    copies = spark.read.parquet(f"{table}/copies").groupBy("text_key", "source_type", "document_id").agg(
        F.min(F.struct("acquired_at", "document_id", *[c for c in _IDENTITY if c not in (
            "acquired_at", "document_id")])).alias("doc"))
    owners = copies.groupBy("text_key", "source_type").agg(
        F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))
    log = spark.read.parquet(f"{table}/chunks")
    made = log.groupBy("text_key").agg(F.min("batch").alias("batch"))
    return (log.join(owners.join(made, "text_key"), ["text_key", "batch"])
            .select("text_key", "source_type", "doc.*", "copies", "chunk_index", "content", "content_hash",
                    ids.chunk_id(F.col("doc.document_id"), F.col("chunk_index")).alias("chunk_id")))


# ---- alerts ----------------------------------------------------------------------------------

def alert_stream(events: DataFrame, table: str, checkpoint: str) -> None:
    """Error-rate and latency counts per hour, one folder of partial counts per trigger.

    The stream keeps no state and knows no lateness: an event joins its hour when the partial
    counts are added up, whichever trigger it came in. ``latest_alerts`` adds them,
    ``compact_alerts`` keeps their number small, ``untimed`` counts events without a time.
    """
    def write(batch: DataFrame, number: int) -> None:
        audit.alert_partials(batch).write.mode("overwrite").parquet(f"{table}/run={number}")

    _drain(events, write, checkpoint)


def alert_counts(spark: SparkSession, table: str) -> DataFrame:
    """The newest merged counts and all triggers after them."""
    merged, runs = finished_folders(spark, table, "base"), finished_folders(spark, table, "run")
    newest = max(merged, default=None)
    paths = [path for n, path in runs.items() if newest is None or n > newest]
    paths += [merged[newest]] if merged else []
    return spark.read.schema(audit.PARTIAL_SCHEMA).parquet(*paths)


def latest_alerts(spark: SparkSession, table: str) -> DataFrame:
    return audit.partial_alerts(alert_counts(spark, table))


def untimed(spark: SparkSession, table: str) -> DataFrame:
    return audit.untimed_events(alert_counts(spark, table))


def compact_alerts(spark: SparkSession, table: str) -> int:
    """Add the counts of all triggers so far into one folder; returns the number of the last.

    Readers go on with what they have listed: only what an earlier compaction superseded is
    removed. A trigger that runs again afterwards writes a folder that readers no longer look at.
    """
    merged, runs = finished_folders(spark, table, "base"), finished_folders(spark, table, "run")
    last, before = max(runs), max(merged, default=None)
    if last == before:
        return last
    audit.merge_partials(alert_counts(spark, table)).write.mode("overwrite").parquet(f"{table}/base={last}")
    if before is not None:
        for n, path in [*runs.items(), *merged.items()]:
            if n < before or path == runs.get(before):
                remove_folder(spark, path)
    return last
