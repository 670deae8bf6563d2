"""Catalogue listings, lookups and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain.functions import ids, scoring
from claimgrain.operators import catalog, seen, timeline
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.session import work_folder
from claimgrain.sources import adapters as ad

_GROUPED = """grouped AS (
  SELECT document_id, arg_min(source_name, chunk_id) AS source_name, arg_min(source_type, chunk_id) AS source_type,
    any_value(source_url) AS source_url, arg_min(evidence_tier, chunk_id) AS evidence_tier,
    arg_min(acquired_at, chunk_id) AS acquired_at, count(*) AS chunk_count FROM %s GROUP BY document_id)"""


def _stamp(name="acquired_at"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@register("list_sources", q.query(
    f"{q.ALL_CHUNKS},\nkept AS (SELECT * FROM chunks WHERE evidence_tier = 3),\n{_GROUPED % 'kept'}", """
SELECT document_id, source_name, source_type, source_url, evidence_tier,
  strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at, chunk_count
FROM grouped ORDER BY grouped.acquired_at DESC, document_id LIMIT 100 OFFSET 20"""))
def list_sources(spark, sf):
    page = catalog.list_sources(ad.chunks(spark, sf, tier=3), tier=3, limit=100, offset=20)
    return page.withColumn("acquired_at", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss"))


@register("all_sources", q.query(f"{q.ALL_CHUNKS},\n{_GROUPED % 'chunks'}", """
SELECT document_id, source_name, source_type, source_url, evidence_tier,
  strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at, chunk_count FROM grouped"""))
def all_sources(spark, sf):
    return catalog.group_sources(ad.chunks(spark, sf)).withColumn(
        "acquired_at", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss"))


@register("count_sources", q.query(q.ALL_CHUNKS, """
SELECT count(DISTINCT document_id) AS total FROM chunks WHERE evidence_tier = 3"""))
def count_sources(spark, sf):
    return catalog.count_sources(ad.chunks(spark, sf, tier=3), tier=3)


@register("list_chunks", q.query(q.ALL_CHUNKS, """
SELECT chunk_id, document_id, source_name, source_type, source_url, evidence_tier,
  strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at,
  substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '…' ELSE '' END AS snippet
FROM chunks WHERE source_type = 'pubmed' AND evidence_tier = 1 ORDER BY chunk_id LIMIT 50 OFFSET 10"""))
def list_chunks(spark, sf):
    page = catalog.list_chunks(ad.chunks(spark, sf, "pubmed", 1), source_type="pubmed", tier=1, limit=50, offset=10)
    return page.withColumn("acquired_at", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss"))


@register("chunk_lookup", q.query(q.ALL_CHUNKS, f"""
SELECT w.chunk_id, c.document_id, c.content_hash, c.chunk_id IS NOT NULL AS found
FROM (SELECT document_id || '_0001' AS chunk_id FROM ided) w LEFT JOIN chunks c USING (chunk_id)"""))
def chunk_lookup(spark, sf):
    """The second chunk of every document; short documents have none."""
    wanted = ad.first_chunk_ids(spark, sf).select(
        ids.chunk_id(F.col("document_id"), F.lit(1)).alias("chunk_id"))
    return catalog.lookup_chunks(ad.chunks(spark, sf), wanted)


def _deletes(spark, sf):
    """Documents labelled toxic, each with an id nobody has."""
    toxic = ad.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    docs = ad.first_chunk_ids(spark, sf).join(toxic, "doc_id", "left_semi")
    return docs.select("document_id").unionByName(
        docs.select(F.concat(F.lit("missing-"), "document_id").alias("document_id")))


@register("delete_source", q.query(q.ALL_CHUNKS, "SELECT chunk_id, source_type FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def delete_source(spark, sf):
    remaining, _ = catalog.delete_sources(ad.chunks(spark, sf), _deletes(spark, sf))
    return remaining.select("chunk_id", "source_type")


@register("delete_source_report", q.query(q.ALL_CHUNKS, """
SELECT document_id, count(*) AS chunks_deleted FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id
UNION ALL SELECT 'missing-' || document_id, 0 FROM ided WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def delete_source_report(spark, sf):
    return catalog.delete_sources(ad.chunks(spark, sf), _deletes(spark, sf))[1]


@register("delete_chunk", q.query(q.ALL_CHUNKS, """
SELECT chunk_id, document_id FROM chunks WHERE NOT (chunk_index = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"""))
def delete_chunk(spark, sf):
    poor = ad.table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    first = ad.first_chunk_ids(spark, sf).join(poor, "doc_id", "left_semi").select("chunk_id")
    return catalog.delete_chunks(ad.chunks(spark, sf), first).select("chunk_id", "document_id")


def _patched(spark, sf):
    """Patches from the labels: poor documents to tier 5, toxic good ones to a tier that does
    not exist, the rest only a note."""
    tier = F.when(F.col("quality") == 0, 5).when(F.col("toxic") == 1, 9)
    patches = ad.first_chunk_ids(spark, sf).join(ad.table(spark, sf, "labels"), "doc_id").select(
        "chunk_id", tier.alias("tier_override"),
        F.when(F.col("quality") == 1, F.concat(F.lit("note "), F.col("doc_id").cast("string")))
        .alias("notes"))
    return catalog.patch_chunks(ad.chunks(spark, sf), patches)


_JOINED = """patched AS (
  SELECT c.*, c.chunk_index = 0 AND l.quality = 0 AS poor,
    c.chunk_index = 0 AND l.quality = 1 AND l.toxic = 0 AS good
  FROM chunks c LEFT JOIN labels l USING (doc_id))"""


@register("patch_chunks", q.query(f"{q.ALL_CHUNKS},\n{_JOINED}", """
SELECT chunk_id, CASE WHEN poor THEN 5 ELSE evidence_tier END AS evidence_tier,
  CASE WHEN good THEN 'note ' || doc_id END AS notes FROM patched"""))
def patch_chunks(spark, sf):
    return _patched(spark, sf).select("chunk_id", "evidence_tier", "notes")


@register("patch_log", q.query(f"{q.ALL_CHUNKS},\n{_JOINED}", """
SELECT chunk_id, evidence_tier AS before, CASE WHEN poor THEN 5 ELSE evidence_tier END AS after,
  CASE WHEN good THEN 'note ' || doc_id END AS notes FROM patched WHERE poor OR good"""))
def patch_log(spark, sf):
    return catalog.change_log(_patched(spark, sf))


@register("id_validity", r"""
SELECT url AS id, regexp_full_match(url, '[\pL\pN_\-:.]+') AS valid FROM pages
UNION ALL SELECT 'doc:' || source || '_' || doc_id, true FROM documents""")
def id_validity(spark, sf):
    rows = ad.table(spark, sf, "pages").select(F.col("url").alias("id")).unionByName(
        ad.table(spark, sf, "documents").select(
            F.concat(F.lit("doc:"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("id")))
    return catalog.id_validity(rows, "id")


@register("tier_downgrade", q.query(q.DOCS, f"""
SELECT doc_id, {q.tier()} AS evidence_tier, CASE WHEN source_type = 'pubmed' AND doc_id % 11 = 0 OR contains(raw_content, 'newsletter') THEN 5
  WHEN doc_id % 7 = 0 THEN least(5, {q.tier()} + 1) ELSE {q.tier()} END AS new_tier FROM docs"""))
def tier_downgrade(spark, sf):
    from claimgrain.functions.scoring import infer_tier
    kind = F.col("source_type")
    signals = ad.docs_meta(spark, sf).select(
        "doc_id", infer_tier(kind, F.col("source_name")).alias("evidence_tier"),
        (F.col("doc_id") % 7 == 0).alias("stale"),
        F.col("raw_content").contains("newsletter").alias("marketing"),
        ((kind == "pubmed") & (F.col("doc_id") % 11 == 0)).alias("retracted"))
    return catalog.downgrade_tiers(signals).select("doc_id", "evidence_tier", "new_tier")


@register("tier_as_of", q.query(f"{q.DOCS},\n{q.IDED}" + """,
given AS (SELECT source_name, acquired_at + INTERVAL 30 SECOND AS valid_from,
    CASE WHEN toxic = 1 THEN acquired_at + INTERVAL 1 HOUR END AS valid_to,
    CASE WHEN quality = 0 THEN 5 ELSE 2 END AS tier FROM ided JOIN labels USING (doc_id)),
latest AS (SELECT d.doc_id, max(g.valid_from) AS valid_from
  FROM ided d LEFT JOIN given g ON g.source_name = d.source_name AND g.valid_from <= d.acquired_at GROUP BY d.doc_id)""", """
SELECT d.doc_id, CASE WHEN g.valid_to IS NULL OR d.acquired_at < g.valid_to THEN coalesce(g.tier, d.evidence_tier)
  ELSE d.evidence_tier END AS evidence_tier
FROM ided d JOIN latest l USING (doc_id)
LEFT JOIN given g ON g.source_name = d.source_name AND g.valid_from = l.valid_from"""))
def tier_as_of(spark, sf):
    """The tier of every document under the judgement of its source that held when it was acquired:
    each labelled document is a judgement of its source, good for an hour if it was toxic."""
    docs = ad.shape_docs(ad.table(spark, sf, "documents")).select(
        "doc_id", "source_name", "acquired_at", scoring.infer_tier(
            F.col("source_type"), F.col("source_name")).alias("inferred"))
    given = docs.join(ad.table(spark, sf, "labels"), "doc_id").select(
        "source_name", (F.col("acquired_at") + F.expr("INTERVAL 30 SECONDS")).alias("valid_from"),
        F.when(F.col("toxic") == 1, F.col("acquired_at") + F.expr("INTERVAL 1 HOUR")).alias("valid_to"),
        F.when(F.col("quality") == 0, 5).otherwise(2).alias("tier"))
    found = timeline.as_of_join(docs, given, "source_name", "acquired_at", "valid_from", until="valid_to")
    return found.select("doc_id", F.coalesce("asof.tier", "inferred").alias("evidence_tier"))


@register("dedup_across_runs", """
SELECT arg_min(doc_id, (doc_id % 3, doc_id)) AS doc_id, min(doc_id % 3) AS run FROM documents
WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, doc_id % 3 FROM documents WHERE text IS NULL""")
def dedup_across_runs(spark, sf):
    """Three runs over parts of the documents, each admitting the texts that none before it had."""
    path = work_folder(spark, "seen")
    docs = ad.table(spark, sf, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))
    done = [seen.admit(docs.filter(F.col("doc_id") % 3 == run), path, run, order=["doc_id"]).select(
        "doc_id", F.lit(run).cast("bigint").alias("run")) for run in range(3)]
    return done[0].unionByName(done[1]).unionByName(done[2])
