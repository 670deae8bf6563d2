"""Ingestion, deduplication and table-update queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain.functions import ids
from claimgrain.operators import ingest, versions
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.session import stored, work_folder
from claimgrain.sources import adapters as ad


@register("ingest_all", q.query(q.ALL_CHUNKS, f"""
SELECT chunk_id, document_id, source_type, source_name, source_url, {q.iso('acquired_at')} AS acquired_at,
  evidence_tier, content_hash, content, chunk_index FROM chunks"""))
def ingest_all(spark, sf):
    return ad.chunks(spark, sf).select(
        "chunk_id", "document_id", "source_type", "source_name", "source_url",
        ids.isoformat(F.col("acquired_at")).alias("acquired_at"), "evidence_tier", "content_hash",
        "content", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@register("exact_dedup", q.query(q.ALL_CHUNKS, """
SELECT content_hash, evidence_tier, chunk_id, source_type, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies,
    row_number() OVER (PARTITION BY content_hash ORDER BY evidence_tier, acquired_at, chunk_id) AS pos
  FROM chunks) WHERE pos = 1"""))
def exact_dedup(spark, sf):
    rows = ad.chunks(spark, sf).select("content_hash", "evidence_tier", "acquired_at", "chunk_id",
                                       "source_type")
    return ingest.exact_dedup(rows, "content_hash", ["evidence_tier", "acquired_at", "chunk_id"]
                              ).drop("acquired_at")


@register("ingest_summary", q.query(",\n".join([q.DOCS, q.IDED, q.CLEANED]), """
SELECT COALESCE(source_type, 'total') AS source_type, count(*) AS documents,
  CAST(sum(n_chunks) AS BIGINT) AS chunks, CAST(sum(CASE WHEN clean = '' THEN 1 ELSE 0 END) AS BIGINT) AS skipped
FROM counted GROUP BY ROLLUP (source_type)"""))
def ingest_summary(spark, sf):
    return ingest.ingest_summary(ad.docs_meta(spark, sf))


@register("run_summary", q.query(q.RESULTS, """
SELECT COALESCE(source_type, 'total') AS source_type, CAST(sum(n) AS BIGINT) AS total_chunks,
  CAST(sum(CASE WHEN failed THEN 2 ELSE 0 END) AS BIGINT) AS errors, round(sum(seconds), 2) AS duration_seconds,
  CASE WHEN sum(CASE WHEN failed THEN 2 ELSE 0 END) = 0 THEN 'ok' ELSE 'error' END AS status
FROM results GROUP BY ROLLUP (source_type)"""))
def run_summary(spark, sf):
    return ingest.run_summary(ad.run_results(spark, sf))


UPSERT_SQL = q.query(q.ALL_CHUNKS, """
SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE evidence_tier END AS evidence_tier,
  CASE WHEN doc_id % 4 = 0 THEN content_hash || ':2' ELSE content_hash END AS content_hash FROM chunks
UNION ALL SELECT 'new-' || chunk_id, 1, content_hash || ':2' FROM chunks WHERE doc_id % 4 = 1""")


def _changes(spark, sf):
    """Every fourth document is changed twice, every fourth brings new chunks, in one batch. Base and
    changes read the chunks several times; they are cut and hashed once and stored without text."""
    base = stored(ad.chunks(spark, sf).select("doc_id", "chunk_id", "evidence_tier", "content_hash"), "chunks")
    kind = F.col("doc_id") % 4
    versions = base.filter(kind <= 1).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    changes = versions.select(
        F.when(kind == 1, F.concat(F.lit("new-"), "chunk_id")).otherwise(F.col("chunk_id"))
        .alias("chunk_id"), (F.lit(3) - F.col("version")).alias("evidence_tier"),
        F.concat_ws(":", "content_hash", F.col("version").cast("string")).alias("content_hash"),
        "version")
    return base.drop("doc_id"), changes


@register("chunk_upsert", UPSERT_SQL)
def chunk_upsert(spark, sf):
    return ingest.upsert(*_changes(spark, sf), "chunk_id", "version")


@register("chunk_upsert_versions", UPSERT_SQL)
def chunk_upsert_versions(spark, sf):
    """The same through a stored table: a new version beside the one that readers have open."""
    path = work_folder(spark, "chunks")
    base, changes = _changes(spark, sf)
    versions.create(base, path, "chunk_id", buckets=16)
    versions.change(spark, path, changes, "chunk_id", "version", buckets=16)
    return versions.read(spark, path)


_KINDS = "['website', 'blog', 'youtube', 'podcast']"


@register("registry_append", f"""
WITH r AS (
  SELECT 'https://corpus.example/' || source || '/' || (doc_id % 500) AS url, doc_id AS seq,
    ({_KINDS})[1 + CAST(doc_id % 4 AS INT)] AS source_type, lang AS label FROM documents),
f AS (SELECT *, count(*) OVER (PARTITION BY url) AS requests,
  row_number() OVER (PARTITION BY url ORDER BY seq) AS pos FROM r),
known AS (SELECT DISTINCT 'https://corpus.example/' || source || '/' || doc_id AS url FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT url, seq, source_type, label, requests,
  CASE source_type WHEN 'website' THEN 'websites/urls.txt' WHEN 'blog' THEN 'websites/urls.txt'
    WHEN 'youtube' THEN 'youtube/video_ids.txt' ELSE '' END AS list_file,
  CASE WHEN source_type = 'podcast' THEN 'unsupported'
    WHEN url IN (SELECT url FROM known) THEN 'already registered' ELSE 'added' END AS verdict
FROM f WHERE pos = 1""")
def registry_append(spark, sf):
    docs = ad.table(spark, sf, "documents")
    url = lambda n: F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), n.cast("string"))
    labels = ad.table(spark, sf, "labels").select("doc_id")
    registry = docs.join(labels, "doc_id", "left_semi").select(url(F.col("doc_id")).alias("url"))
    kinds = F.array(*map(F.lit, ["website", "blog", "youtube", "podcast"]))
    requested = docs.select(url(F.col("doc_id") % 500).alias("url"), F.col("doc_id").alias("seq"),
                            F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("source_type"),
                            F.col("lang").alias("label"))
    return ingest.register_sources(registry, requested)


@register("tier_override", q.query(q.DOCS, f"""
SELECT d.doc_id, COALESCE(CASE WHEN source_url IS NOT NULL THEN 2 - l.quality + 2 * l.toxic END, {q.tier()}) AS evidence_tier
FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id"""))
def tier_override(spark, sf):
    docs = ad.docs_meta(spark, sf).drop("raw_content")
    registry = docs.filter("source_url IS NOT NULL").join(ad.table(spark, sf, "labels"), "doc_id").select(
        "source_url", (2 - F.col("quality") + 2 * F.col("toxic")).alias("tier_override"))
    return ingest.apply_tier_overrides(docs, registry).select("doc_id", "evidence_tier")
