"""Streaming twins: the stream drains the table, the result equals the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain.plans import sqltext as q
from claimgrain.plans.audit_queries import ALERTS_SQL, rounded_alerts
from claimgrain.plans.registry import register
from claimgrain.session import work_folder
from claimgrain.sources import adapters as ad
from claimgrain.streaming import jobs


@register("stream_ingest", q.query(q.ALL_CHUNKS, """
SELECT chunk_id, source_type, evidence_tier, content_hash, chunk_index FROM chunks"""))
def stream_ingest(spark, sf):
    folder = work_folder(spark, "ingest")
    docs = ad.shape_docs(jobs.read_table_stream(spark, sf, "documents"))
    jobs.ingest_stream(docs, f"{folder}/table", f"{folder}/checkpoint")
    return jobs.current_chunks(spark, f"{folder}/table").select(
        "chunk_id", "source_type", "evidence_tier", "content_hash",
        F.col("chunk_index").cast("bigint").alias("chunk_index"))


@register("stream_distinct", q.query(q.ALL_CHUNKS + """,
owners AS (
  SELECT arg_min(doc_id, (acquired_at, document_id)) AS doc_id, count(DISTINCT document_id) AS copies
  FROM ided GROUP BY source_type, raw_content)""", """
SELECT c.chunk_id, c.source_type, c.content_hash, c.chunk_index, o.copies
FROM chunks c JOIN owners o USING (doc_id)"""))
def stream_distinct(spark, sf):
    """Every distinct text cut once, under the first document that holds it."""
    folder = work_folder(spark, "distinct")
    docs = ad.shape_docs(jobs.read_table_stream(spark, sf, "documents"))
    jobs.distinct_stream(docs, f"{folder}/table", f"{folder}/checkpoint")
    return jobs.distinct_chunks(spark, f"{folder}/table").select(
        "chunk_id", "source_type", "content_hash", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "copies")


@register("stream_alerts", ALERTS_SQL)
def stream_alerts(spark, sf):
    folder = work_folder(spark, "alerts")
    events = ad.shape_events(jobs.read_table_stream(spark, sf, "events"))
    jobs.alert_stream(events, f"{folder}/table", f"{folder}/checkpoint")
    return rounded_alerts(jobs.latest_alerts(spark, f"{folder}/table"))
