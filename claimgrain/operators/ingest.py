"""From raw documents to hashed, tier-labelled chunks, and keyed table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import chunking, ids, scoring, text
from claimgrain.functions.embedding import hash_vector

CHUNK_COLUMNS = ["chunk_id", "document_id", "source_type", "source_name", "source_url",
                 "acquired_at", "published_at", "evidence_tier", "content_hash", "content",
                 "chunk_index"]


def spread(rows: DataFrame, *keys: str, tasks_per_core: int = 4) -> DataFrame:
    """Spread a scan over the cores if its files give too few tasks for CPU-heavy text work.

    A large table has far more splits than the cluster has cores and is left as it is, so
    no text is shuffled there. The keys, unique per row, are hashed rather than rows dealt
    out, so a retried task sees the same rows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores * tasks_per_core, *keys)


def with_document_ids(docs: DataFrame) -> DataFrame:
    """Stable ids: re-ingesting the same document gives the same id."""
    return docs.withColumn("document_id", ids.document_id(
        F.col("source_url"), F.col("acquired_at"), F.col("source_name"),
        ids.content_hash(F.col("raw_content"))))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Per-type cleaning: boilerplate removal for documents and pages, whitespace for all."""
    source = F.coalesce(F.col("raw_content"), F.lit(""))
    stripped = F.when(F.col("source_type").isin(dims.BOILERPLATE_TYPES),
                      text.drop_boilerplate(source)).otherwise(source)
    return (docs.withColumn("clean", stripped)
            .withColumn("clean", text.normalize_whitespace(F.col("clean"))))


def chunk_documents(docs: DataFrame, size: int = dims.WINDOW_TOKENS,
                    overlap: int = dims.WINDOW_OVERLAP) -> DataFrame:
    """One row per chunk (``chunk_index``, ``content``); blank documents give no rows.

    Narrow: the text never leaves its task. Words and paragraphs are each split once and
    sliced, so a long document costs its own length, not length x chunks.
    """
    by_paragraph = F.col("source_type").isin(dims.PARAGRAPH_TYPES)
    parts = docs.withColumn("parts", F.when(by_paragraph, chunking.paragraphs(F.col("clean")))
                            .otherwise(text.words(F.col("clean"))))
    chunks = F.when(by_paragraph, chunking.paragraph_groups(
        F.col("parts"), dims.PARAGRAPHS_PER_CHUNK)).otherwise(
        chunking.token_windows(F.col("parts"), size, overlap))
    keep = [c for c in docs.columns if c not in ("raw_content", "clean")]
    return (parts.select(*keep, F.posexplode(chunks).alias("chunk_index", "content"))
            .filter(F.col("content") != ""))


def ingest(docs: DataFrame, size: int = dims.WINDOW_TOKENS,
           overlap: int = dims.WINDOW_OVERLAP) -> DataFrame:
    """Clean, chunk, identify and hash. No shuffle; a single pass over the input."""
    if "document_id" not in docs.columns:
        docs = with_document_ids(docs)
    chunks = chunk_documents(clean_documents(docs), size, overlap)
    if "evidence_tier" not in chunks.columns:
        # every source has its type's tier; names are only consulted by enrich_metadata
        chunks = chunks.withColumn("evidence_tier", scoring.source_type_tier(F.col("source_type")))
    return (chunks
            .withColumn("chunk_id", ids.chunk_id(F.col("document_id"), F.col("chunk_index")))
            .withColumn("content_hash", ids.content_hash(F.col("content"))))


def enrich_metadata(docs: DataFrame) -> DataFrame:
    """Document-level metadata: hash, id, tier and ISO timestamps."""
    return docs.select(
        "source_type", "source_name", "source_url",
        ids.isoformat(F.col("acquired_at")).alias("acquired_at"),
        ids.isoformat(F.col("published_at")).alias("published_at"),
        scoring.infer_tier(F.col("source_type"), F.col("source_name"))
        .alias("evidence_tier_default"),
        ids.content_hash(F.col("raw_content")).alias("content_hash"),
        ids.document_id(F.col("source_url"), F.col("acquired_at"), F.col("source_name"))
        .alias("document_id"))


def exact_dedup(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key. An aggregate, not a window: copies are combined before the
    shuffle, so a key holding a third of the table costs one row per task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("best")
    return (rows.groupBy(key).agg(best, F.count(F.lit(1)).alias("copies"))
            .select(key, "best.*", "copies"))


def document_results(docs: DataFrame) -> DataFrame:
    """Chunks per document and whether it was skipped, per source type."""
    parts = clean_documents(docs)
    blank = F.col("clean") == ""
    by_paragraph = F.col("source_type").isin(dims.PARAGRAPH_TYPES)
    counted = parts.withColumn("n_parts", F.when(
        by_paragraph, F.size(chunking.paragraphs(F.col("clean"))))
        .otherwise(F.size(text.words(F.col("clean")))))
    stride = dims.WINDOW_TOKENS - dims.WINDOW_OVERLAP
    windows = F.greatest(F.lit(1), F.ceil((F.col("n_parts") - dims.WINDOW_OVERLAP) / stride))
    groups = F.ceil(F.col("n_parts") / dims.PARAGRAPHS_PER_CHUNK)
    return counted.select(
        "source_type", blank.cast("long").alias("skipped"),
        F.when(F.col("n_parts") == 0, F.lit(0)).when(by_paragraph, groups)
        .otherwise(windows).cast("long").alias("chunks"))


def ingest_summary(docs: DataFrame) -> DataFrame:
    """Documents, chunks and skipped documents per source type, and in total."""
    return (document_results(docs).rollup("source_type")
            .agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"),
                 F.sum("skipped").alias("skipped"))
            .withColumn("source_type", F.coalesce("source_type", F.lit("total"))))


def run_summary(results: DataFrame) -> DataFrame:
    """Per-source run report over result rows (count, errors, duration), with a total row."""
    return (results.rollup("source_type")
            .agg(F.sum("count").alias("total_chunks"),
                 F.sum(F.size("errors")).cast("long").alias("errors"),
                 F.round(F.sum("duration_seconds"), 2).alias("duration_seconds"))
            .withColumn("source_type", F.coalesce("source_type", F.lit("total")))
            .withColumn("status", F.when(F.col("errors") == 0, "ok").otherwise("error")))


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of ``base`` replaced or extended by the latest change per key.

    Changes are reduced to one row per key first (combined before the shuffle), so the
    anti-join sees unique keys on both sides and cannot be skewed by repeated updates.
    """
    cols = [c for c in base.columns if c != key]
    latest = (changes.groupBy(key)
              .agg(F.max_by(F.struct(*cols), F.col(version)).alias("row"))
              .select(key, "row.*"))
    kept = base.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*base.columns))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(base: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """A keyed table stored by hash bucket of its key, one folder per bucket."""
    (base.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def upsert_bucketed(spark, path: str, changes: DataFrame, key: str, version: str,
                    buckets: int = 256) -> int:
    """Apply changes to a stored table and rewrite only the buckets that they touch; the number
    of those is returned.

    Buckets without a change are neither read nor written, so the cost follows the changes. At
    most ``buckets`` small numbers reach the driver.
    """
    placed = changes.withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
    if touched:
        base = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        (upsert(base, placed, key, version).repartition("bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    return len(touched)


def latest_per_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key of a stored log in which most keys occur once.

    Only keys and counts of the whole log are shuffled. Full rows meet in an aggregate for
    repeated keys alone; the others pass through an anti-join that Spark can broadcast.
    """
    cols = [c for c in rows.columns if c != key]
    repeated = (rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1).select(key))
    newest = (rows.join(repeated, key, "left_semi").groupBy(key)
              .agg(F.max_by(F.struct(*cols), version).alias("row")).select(key, "row.*"))
    return rows.join(repeated, key, "left_anti").unionByName(newest)


def reindex(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The vector store with every given chunk embedded anew; other rows stay."""
    vectors = chunks.select("chunk_id", hash_vector(F.col("content")).alias("vector"),
                            F.lit(1).alias("version"))
    return upsert(store, vectors, "chunk_id", "version")


def register_sources(registry: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested URLs with a verdict: added, already registered, repeated or unsupported."""
    supported = list(dims.URL_LISTS)
    folder, file = F, F
    for kind, (sub, name) in dims.URL_LISTS.items():
        folder = folder.when(F.col("source_type") == kind, sub)
        file = file.when(F.col("source_type") == kind, name)
    known = registry.select("url").distinct().withColumn("known", F.lit(True))
    best = (requested.groupBy("url")
            .agg(F.min(F.struct("seq", "source_type", "label")).alias("first"),
                 F.count(F.lit(1)).alias("requests"))
            .select("url", "first.*", "requests"))
    return (best.join(known, "url", "left")
            .withColumn("list_file", F.concat_ws("/", folder, file))
            .withColumn("verdict", F.when(~F.col("source_type").isin(supported), "unsupported")
                        .when(F.col("known"), "already registered").otherwise("added"))
            .drop("known"))


def source_line(url: Column, label: Column) -> Column:
    """List-file line of a registered source: the value, then an optional label comment."""
    return F.concat(url, F.when(F.coalesce(label, F.lit("")) != "",
                                F.concat(F.lit("  # "), label)).otherwise(""))


def apply_tier_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """The tier given at registration wins over the inferred one."""
    inferred = scoring.source_type_tier(F.col("source_type"))
    return (docs.join(overrides.select("source_url", "tier_override"), "source_url", "left")
            .withColumn("evidence_tier", F.coalesce("tier_override", inferred)))
