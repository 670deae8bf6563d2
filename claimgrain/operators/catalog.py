"""Catalogue queries and edits over the chunk table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import ids


def equalities(**wanted) -> Column:
    """AND of column = value for the values given; NULL or empty means no condition."""
    conditions = [F.col(c) == F.lit(v) for c, v in wanted.items() if v not in (None, "", 0)]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def group_sources(chunks: DataFrame) -> DataFrame:
    """One row per document with its first chunk's attributes and the chunk count."""
    attrs = F.struct("source_name", "source_type", "source_url", "evidence_tier", "acquired_at")
    return (chunks.groupBy("document_id")
            .agg(F.min_by(attrs, F.col("chunk_id")).alias("a"),
                 F.count(F.lit(1)).alias("chunk_count"))
            .select("document_id", "a.*", "chunk_count"))


def list_sources(chunks: DataFrame, source_type: str | None = None, tier: int | None = None,
                 limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of documents, newest first."""
    kept = chunks.filter(equalities(source_type=source_type, evidence_tier=tier))
    return page(group_sources(kept), [F.desc("acquired_at"), "document_id"], limit, offset)


def count_sources(chunks: DataFrame, source_type: str | None = None,
                  tier: int | None = None) -> DataFrame:
    kept = chunks.filter(equalities(source_type=source_type, evidence_tier=tier))
    return kept.select("document_id").distinct().agg(F.count(F.lit(1)).alias("total"))


def snippet(content: Column) -> Column:
    return F.concat(F.substring(content, 1, dims.SNIPPET_CHARS),
                    F.when(F.length(content) > dims.SNIPPET_CHARS, "…").otherwise(""))


def list_chunks(chunks: DataFrame, source_type: str | None = None, tier: int | None = None,
                document_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of chunks with a short snippet, by chunk id."""
    kept = chunks.filter(equalities(source_type=source_type, evidence_tier=tier,
                                    document_id=document_id))
    # the page is cut on narrow rows that carry only the snippet
    rows = kept.select("chunk_id", "document_id", "source_name", "source_type", "source_url",
                       "evidence_tier", "acquired_at", snippet(F.col("content")).alias("snippet"))
    return page(rows, ["chunk_id"], limit, offset)


def lookup_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks for a table of ids; ids that are unknown are reported, not dropped."""
    known = chunks.select("chunk_id", "document_id", "content_hash", F.lit(True).alias("hit"))
    return (wanted.select("chunk_id").distinct().join(known, "chunk_id", "left")
            .withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit"))


def delete_sources(chunks: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining chunks, deleted chunk count per requested document)."""
    gone = deletes.select("document_id").distinct()
    remaining = chunks.join(gone, "document_id", "left_anti")
    counts = (chunks.select("document_id").join(gone, "document_id", "left_semi")
              .groupBy("document_id").agg(F.count(F.lit(1)).alias("n")))
    report = gone.join(counts, "document_id", "left").select(
        "document_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("chunks_deleted"))
    return remaining, report


def delete_chunks(chunks: DataFrame, deletes: DataFrame) -> DataFrame:
    return chunks.join(deletes.select("chunk_id").distinct(), "chunk_id", "left_anti")


def patch_chunks(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """Chunks with tier and notes replaced where a valid patch (tier 1..5) exists.

    Keeps the old tier in ``tier_before`` and marks changed rows, which is the change log.
    Several patches of a chunk are allowed if they carry ``seq``: per field the last value
    set wins. Without ``seq`` there must be one patch per chunk.
    """
    valid = patches.filter(F.col("tier_override").isNull()
                           | F.col("tier_override").between(1, 5))
    if "seq" in patches.columns:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        valid = valid.groupBy("chunk_id").agg(last("tier_override"), last("notes"))
    return (chunks.join(valid.select("chunk_id", "tier_override", "notes"), "chunk_id", "left")
            .withColumn("tier_before", F.col("evidence_tier"))
            .withColumn("evidence_tier", F.coalesce("tier_override", "evidence_tier"))
            .withColumn("changed", F.col("tier_override").isNotNull() | F.col("notes").isNotNull())
            .drop("tier_override"))


def change_log(patched: DataFrame) -> DataFrame:
    return patched.filter("changed").select(
        "chunk_id", F.col("tier_before").alias("before"), F.col("evidence_tier").alias("after"),
        "notes")


def id_validity(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("valid", ids.valid_id(F.col(column)))


def downgrade_tiers(sources: DataFrame) -> DataFrame:
    """Retraction or marketing copy to 5; a stale URL one tier down, at most to 5."""
    return sources.withColumn("new_tier", F.when(F.col("retracted") | F.col("marketing"), F.lit(5))
                              .when(F.col("stale"), F.least(F.lit(5), F.col("evidence_tier") + 1))
                              .otherwise(F.col("evidence_tier")))
