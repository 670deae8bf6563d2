"""Evidence-weighted ranking of retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrain.dims import DEFAULT_RELEVANCE
from claimgrain.functions import scoring
from claimgrain.operators.graph import supports
from claimgrain.session import stored


def rank_evidence(hits: DataFrame, as_of: Column, key: str = "query_id",
                  tiebreak: tuple[str, ...] = ("retrieval_rank",),
                  k: int | None = None) -> DataFrame:
    """Composite score and rank per query; equal scores keep their retrieval order."""
    scored = hits.withColumn("score", F.round(scoring.evidence_score(
        F.col("evidence_tier"), F.col("similarity"), F.col("published_at"), as_of), 9))
    order = Window.partitionBy(key).orderBy(F.desc("score"), *tiebreak)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


# stands behind every vector hit when scores are equal
_AFTER_HITS = 1_000_000_000


def hybrid_topk(hits: DataFrame, edges: DataFrame, meta: DataFrame, as_of: Column,
                k: int = 20, hits_per_query: int | None = None,
                relevance: DataFrame | None = None) -> DataFrame:
    """Vector hits plus the chunks their graph neighbourhood rests on, ranked together.

    ``hits(query_id, id, similarity, retrieval_rank)``,
    ``meta(id, chunk_id, evidence_tier, published_at)``. Chunks found through the graph have no
    similarity and score with the default relevance.

    That score does not depend on the query, so every entity's chunks are ranked once and only
    its first ``k + hits_per_query`` can matter: at most ``hits_per_query`` of them are hits
    themselves. That number is counted from the hits unless the caller knows a bound on it. A
    query's pool is the union of those lists over its entities, however many chunks a hub entity
    supports. Hits without a query or an id take no part.

    With ``relevance(query_id, id, relevance)``, as ``graph.spread_relevance`` makes it, the chunks
    found through the graph are those of that table, and each has the default relevance times its own.
    """
    own = hits.select("query_id", "id", "similarity", "retrieval_rank")
    if relevance is not None:
        near = relevance.join(own.select("query_id", "id"), ["query_id", "id"], "left_anti").select(
            "query_id", "id", (F.col("relevance") * DEFAULT_RELEVANCE).alias("similarity"),
            F.lit(_AFTER_HITS).alias("retrieval_rank"))
        return _ranked_pool(own.join(meta, "id").unionByName(near.join(meta, "id")), as_of, k)
    if hits_per_query is None:
        own = stored(own, "hits")
        most = own.groupBy("query_id").agg(F.count("id").alias("n")).agg(F.max("n")).first()[0]
        hits_per_query = most or 0
    ends = supports(edges)
    reached = own.join(ends, "id").select("query_id", "entity").distinct()
    unseen = (ends.join(meta, "id").withColumn("similarity", F.lit(None).cast("double"))
              .withColumn("retrieval_rank", F.lit(_AFTER_HITS)))
    lists = rank_evidence(unseen, as_of, key="entity", tiebreak=("chunk_id",), k=k + hits_per_query)
    grown = reached.join(lists.drop("score", "rank"), "entity").drop("entity").distinct()
    new = grown.join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _ranked_pool(own.join(meta, "id").unionByName(new), as_of, k)


def _ranked_pool(pool: DataFrame, as_of: Column, k: int) -> DataFrame:
    ranked = rank_evidence(pool, as_of, tiebreak=("retrieval_rank", "chunk_id"), k=k)
    return ranked.withColumn("from_graph", F.col("retrieval_rank") == _AFTER_HITS)
