"""Vector and text retrieval, recency and evidence ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrain.functions import scoring
from claimgrain.functions.embedding import hash_vector
from claimgrain.operators import ingest, quantised, retrieval
from claimgrain.operators.catalog import snippet
from claimgrain.operators.ranking import hybrid_topk, rank_evidence
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.session import stored
from claimgrain.sources import adapters as ad

_HIT = "query_id, id AS chunk_id, CAST(retrieval_rank AS BIGINT) AS rank, round(similarity, 6) AS similarity"


def _corpus(vectors: DataFrame, ident: str = "chunk_id") -> DataFrame:
    return vectors.select(F.col(ident).cast("string").alias("id"), "vector")


def _shape(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("chunk_id"),
                       F.col("retrieval_rank").cast("bigint").alias("rank"),
                       F.round("similarity", 6).alias("similarity"))


@register("vector_topk", q.query(
    f"{q.FIRST},\n{q.VECTORS},\n{q.vector_hits('vecs', 'label_queries', 10)}",
    f"SELECT {_HIT} FROM hits"))
def vector_topk(spark, sf):
    return _shape(retrieval.vector_topk(ad.label_queries(spark, sf),
                                        _corpus(ad.chunk_vectors(spark, sf)), 10))


@register("vector_topk_filtered", q.query(
    f"""{q.FIRST},\n{q.VECTORS},
allowed AS (SELECT * FROM vecs WHERE evidence_tier <= 3 AND source_type <> 'youtube'),
{q.vector_hits('allowed', 'label_queries', 10)}""", f"SELECT {_HIT} FROM hits"))
def vector_topk_filtered(spark, sf):
    allowed = ad.chunk_vectors(spark, sf).filter("evidence_tier <= 3 AND source_type <> 'youtube'")
    return _shape(retrieval.vector_topk(ad.label_queries(spark, sf), _corpus(allowed), 10))


@register("vector_topk_blocks", q.query(
    f"""{q.FIRST},\n{q.VECTORS},
own AS (SELECT CAST(vec_id AS VARCHAR) AS query_id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings),
{q.vector_hits('vecs', 'own', 5)}""", f"SELECT {_HIT} FROM hits"))
def vector_topk_blocks(spark, sf):
    """Every vector as a query: the layout for query sets too large to ship to the tasks."""
    own = ad.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("vector"))
    return _shape(retrieval.vector_topk(own, _corpus(ad.chunk_vectors(spark, sf)), 5,
                                        max_broadcast=64))


def _signature(vector: str) -> str:
    planes = retrieval.hyperplanes(64, 6)
    bits = [f"CASE WHEN list_dot_product({vector}, [{', '.join(repr(float(w)) for w in p)}]::DOUBLE[]) >= 0 "
            f"THEN {1 << b} ELSE 0 END" for b, p in enumerate(planes)]
    return "(" + " + ".join(bits) + ")"


# Neighbours in the given vectors lie near cosine 0.3, where a bit differs with probability 0.4:
# 0.9 of them are met within four flips of six, not within the two that do at cosine 0.8.
_FLIPS = retrieval.ann_radius(6, 0.3, 0.9)


@register("ann_topk", q.query(
    f"""{q.FIRST},\n{q.VECTORS},
cb AS (SELECT chunk_id, vector, {_signature('vector')} AS bucket FROM vecs),
qb AS (SELECT query_id, vector, {_signature('vector')} AS bucket FROM label_queries),
scored AS (
  SELECT q.query_id, c.chunk_id AS id, round(list_cosine_similarity(q.vector, c.vector), 9) AS similarity
  FROM qb q JOIN cb c ON bit_count(xor(q.bucket, c.bucket)) <= {_FLIPS}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS retrieval_rank
  FROM scored QUALIFY retrieval_rank <= 10)""", f"SELECT {_HIT} FROM hits"))
def ann_topk(spark, sf):
    return _shape(retrieval.ann_topk(ad.label_queries(spark, sf),
                                     _corpus(ad.chunk_vectors(spark, sf)), 10, bits=6, probe_bits=_FLIPS))


@register("quantised_topk")
def quantised_topk(spark, sf):
    """Ten nearest vectors of every twentieth vector, over a trained index of all of them."""
    vectors = ad.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = vectors.filter(F.col("id").cast("bigint") % 20 == 0).withColumnRenamed("id", "query_id")
    hits = quantised.quantised_topk(asked, vectors, 10)
    return _shape(hits).withColumnRenamed("chunk_id", "vec_id")


@register("recency_boost", q.query(q.DOCS, f"""
SELECT doc_id, CAST({q.recency()} AS DOUBLE) AS boost FROM docs"""))
def recency_boost(spark, sf):
    return ad.docs_meta(spark, sf).select(
        "doc_id", scoring.recency_boost(F.col("published_at"), ad.as_of()).alias("boost"))


@register("evidence_rank", q.query(
    f"""{q.FIRST},\n{q.VECTORS},\n{q.vector_hits('vecs', 'label_queries', 10)},
s AS (SELECT h.*, v.evidence_tier, v.published_at, {q.score('h.similarity')} AS score
  FROM hits h JOIN vecs v ON v.chunk_id = h.id)""", """
SELECT query_id, id AS chunk_id, evidence_tier, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS rank FROM s"""))
def evidence_rank(spark, sf):
    vectors = ad.chunk_vectors(spark, sf)
    hits = retrieval.vector_topk(ad.label_queries(spark, sf), _corpus(vectors), 10)
    meta = vectors.select("chunk_id", "evidence_tier", "published_at")
    ranked = rank_evidence(hits.join(meta, hits.id == meta.chunk_id), ad.as_of())
    return ranked.select("query_id", "chunk_id", "evidence_tier", F.round("score", 6).alias("score"),
                         F.col("rank").cast("bigint").alias("rank"))


# ---- text retrieval --------------------------------------------------------------------------

def embed(rows: DataFrame, ident: str, content: str, name: str) -> DataFrame:
    """Hash vectors of a text column: (name, vector)."""
    return rows.select(F.col(ident).alias(name), hash_vector(F.col(content)).alias("vector"))


def text_hits(spark, sf, queries: DataFrame, k: int, **kind) -> DataFrame:
    """Top-k chunks of each query; ``doc_id`` leads back to the text."""
    chunks = ad.chunks(spark, sf, **kind).withColumn(
        "key", F.concat_ws("|", "chunk_id", F.col("doc_id").cast("string")))
    hits = retrieval.vector_topk(embed(queries, "query_id", "query", "query_id"),
                                 embed(chunks, "key", "content", "id"), k)
    return hits.withColumn("doc_id", F.substring_index("id", "|", -1).cast("bigint")).withColumn(
        "id", F.substring_index("id", "|", 1))


def with_text(spark, sf, hits: DataFrame) -> DataFrame:
    """Hits with their chunk. Only the documents that were hit are hashed and cut again, so
    text never travels with the vectors.

    The hits are written first: Spark then knows their true size and broadcasts them when they
    are small, instead of shuffling all texts to meet them."""
    docs = ad.shape_docs(ad.table(spark, sf, "documents"))
    hits = stored(hits.withColumnRenamed("id", "hit_id"), "hits")
    return ingest.ingest(docs.join(hits, "doc_id")).filter(F.col("chunk_id") == F.col("hit_id"))


def ranked_chunks(spark, sf, queries: DataFrame, k: int) -> DataFrame:
    """Hits with their text, metadata defaults and evidence rank."""
    found = with_text(spark, sf, text_hits(spark, sf, queries, k))
    return rank_evidence(retrieval.hydrate(found), ad.as_of())


def ranked_tiers(spark, sf, queries: DataFrame, k: int) -> DataFrame:
    """Hits with tier, date and rank alone: no text is read or cut for them."""
    meta = ad.shape_docs(ad.table(spark, sf, "documents")).select(
        "doc_id", "published_at", scoring.source_type_tier(F.col("source_type")).alias("evidence_tier"))
    hits = text_hits(spark, sf, queries, k)
    return rank_evidence(hits.join(meta, "doc_id"), ad.as_of())


@register("hash_embed", q.query(q.ALL_CHUNKS, f"""
SELECT chunk_id, array_to_string(list_transform(range(0, 64),
  lambda b: len(list_filter(bs, lambda x: x = b))), ',') AS counts
FROM (SELECT chunk_id, list_transform({q.words('content')}, lambda w: {q.bucket('w')}) AS bs FROM chunks)"""))
def hash_embed(spark, sf):
    vectors = embed(ad.chunks(spark, sf), "chunk_id", "content", "chunk_id")
    return vectors.select("chunk_id", F.array_join(
        F.transform("vector", lambda v: v.cast("int").cast("string")), ",").alias("counts"))


_BENCH = "bq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"


def _benchmark_queries(spark, sf):
    return ad.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


@register("text_search", q.query(
    f"{q.ALL_CHUNKS},\n{_BENCH},\n{q.text_hits('bq', 5)}", f"SELECT {_HIT} FROM hits"))
def text_search(spark, sf):
    return _shape(text_hits(spark, sf, _benchmark_queries(spark, sf), 5))


@register("chunk_search", q.query(
    f"""{q.ALL_CHUNKS.replace("chunks AS (", "every_chunk AS (")},
chunks AS (SELECT * FROM every_chunk WHERE source_type = 'document' AND evidence_tier = 2),
{_BENCH},\n{q.text_hits('bq', 5)}""", """
SELECT h.query_id, h.retrieval_rank AS rank, c.chunk_id, c.document_id, c.source_name,
  substr(c.content, 1, 200) || CASE WHEN length(c.content) > 200 THEN '…' ELSE '' END AS snippet
FROM hits h JOIN chunks c ON c.chunk_id = h.id"""))
def chunk_search(spark, sf):
    """Semantic search within a metadata filter, with snippets."""
    hits = text_hits(spark, sf, _benchmark_queries(spark, sf), 5,
                     source_type="document", tier=2)
    return with_text(spark, sf, hits).select(
        "query_id", F.col("retrieval_rank").cast("bigint").alias("rank"), "chunk_id",
        "document_id", "source_name", snippet(F.col("content")).alias("snippet"))


@register("hydrate_defaults", q.query(q.DOCS, f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE source_type END AS source_type,
  CASE WHEN doc_id % 5 = 0 THEN 'Unknown Source' ELSE source_name END AS source_name, source_url,
  CASE WHEN doc_id % 6 = 0 THEN 3 ELSE {q.tier()} END AS evidence_tier,
  strftime(CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01' ELSE acquired_at END, '%Y-%m-%d %H:%M:%S') AS acquired_at
FROM docs"""))
def hydrate_defaults(spark, sf):
    doc, name = F.col("doc_id"), F.col("source_name")
    sparse = ad.shape_docs(ad.table(spark, sf, "documents")).select(
        "doc_id", scoring.infer_tier(F.col("source_type"), name).alias("tier"),
        F.when(doc % 4 != 0, F.col("source_type")).otherwise("").alias("source_type"),
        F.when(doc % 5 != 0, name).alias("source_name"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.when(doc % 7 != 0, F.col("acquired_at")).alias("acquired_at"))
    sparse = sparse.withColumn("evidence_tier", F.when(doc % 6 != 0, F.col("tier")))
    return retrieval.hydrate(sparse).select(
        "doc_id", "source_type", "source_name", "source_url", "evidence_tier",
        F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"))


@register("hybrid_retrieval", q.query(
    f"""{q.FIRST},\n{q.VECTORS},\n{q.vector_hits('vecs', 'label_queries', 10, 'doc_id')},
{q.EDGES},
ends AS (SELECT source_chunk_id, src AS entity FROM edges UNION SELECT source_chunk_id, dst FROM edges),
reached AS (SELECT DISTINCT h.query_id, e.entity FROM hits h
  JOIN ends e ON e.source_chunk_id = CAST(h.id AS VARCHAR)),
grown AS (SELECT DISTINCT r.query_id, CAST(e.source_chunk_id AS BIGINT) AS id FROM reached r JOIN ends e USING (entity)),
pool AS (
  SELECT query_id, id, similarity, retrieval_rank FROM hits
  UNION ALL SELECT g.query_id, g.id, NULL, 1000000000 FROM grown g
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = g.query_id AND h.id = g.id)),
s AS (SELECT p.*, f.chunk_id, f.evidence_tier, f.published_at, {q.score('p.similarity')} AS score
  FROM pool p JOIN (SELECT doc_id, chunk_id, evidence_tier, published_at FROM firsts UNION ALL
    SELECT doc_id, chunk_id, evidence_tier, published_at FROM vecs WHERE doc_id NOT IN (SELECT doc_id FROM firsts)) f ON f.doc_id = p.id)""", """
SELECT query_id, chunk_id, retrieval_rank = 1000000000 AS from_graph, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank, chunk_id) AS rank
FROM s QUALIFY rank <= 20"""))
def hybrid_retrieval(spark, sf):
    """Vector hits joined by chunks that share graph entities with them, ranked together."""
    hits = retrieval.vector_topk(ad.label_queries(spark, sf),
                                 _corpus(ad.chunk_vectors(spark, sf), "doc_id"), 10)
    # edges name their supporting chunk by document number here
    own = ad.first_chunk_ids(spark, sf).select("doc_id", "chunk_id", "evidence_tier", "published_at")
    lone = ad.chunk_vectors(spark, sf).select(*own.columns).join(own, "doc_id", "left_anti")
    meta = own.unionByName(lone).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    return hybrid_topk(hits, ad.edges(spark, sf), meta, ad.as_of(), 20).select(
        "query_id", "chunk_id", "from_graph", F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"))
