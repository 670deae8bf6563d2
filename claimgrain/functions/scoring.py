"""Tier, recency and confidence scoring as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrain import dims


def _lookup(key: Column, table: dict, default: Column) -> Column:
    """Small fixed table as a CASE expression: no join, stays inside generated code."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default)


def source_type_tier(source_type: Column) -> Column:
    return _lookup(F.lower(source_type), dims.SOURCE_TYPE_TIERS, F.lit(dims.DEFAULT_TIER))


def infer_tier(source_type: Column, source_name: Column) -> Column:
    """Well-known names first, then the type, then the default."""
    named = F.lower(F.coalesce(source_name, F.lit(""))).rlike("|".join(dims.TIER_ONE_NAMES))
    return F.when(named, F.lit(1)).otherwise(source_type_tier(source_type))


def tier_weight(tier: Column) -> Column:
    return _lookup(tier, dims.TIER_WEIGHTS, F.lit(dims.DEFAULT_TIER_WEIGHT))


def tier_label(tier: Column) -> Column:
    return _lookup(tier, dims.TIER_LABELS, F.concat(F.lit("Tier "), tier.cast("string")))


def recency_boost(published_at: Column, as_of: Column) -> Column:
    years = F.timestamp_diff("DAY", published_at, as_of) / F.lit(365.25)
    return (F.when(published_at.isNull(), dims.UNKNOWN_DATE_BOOST)
            .when(years <= dims.RECENT_YEARS, dims.RECENT_BOOST)
            .when(years <= dims.MIDDLE_YEARS, dims.MIDDLE_BOOST)
            .otherwise(dims.OLD_BOOST))


def evidence_score(tier: Column, similarity: Column, published_at: Column,
                   as_of: Column) -> Column:
    """Weight x relevance x recency. A negative similarity keeps its sign."""
    relevance = F.coalesce(similarity, F.lit(dims.DEFAULT_RELEVANCE))
    return tier_weight(tier) * relevance * recency_boost(published_at, as_of)


def coverage_factor(n: Column) -> Column:
    expr = F
    for least, factor in dims.COVERAGE_FACTORS:
        expr = expr.when(n >= least, F.lit(factor))
    return expr.otherwise(F.lit(0.0))


def confidence(mean_weight: Column, n: Column) -> Column:
    """Mean tier weight times coverage, at most 1, rounded half up to 4 places."""
    # nine places first: the mean must not depend on the order rows were summed in
    score = F.round(F.coalesce(mean_weight, F.lit(0.0)), 9) * coverage_factor(n)
    return F.round(F.least(F.lit(1.0), score), 4)


def confidence_label(score: Column) -> Column:
    expr = F
    for least, label in dims.CONFIDENCE_LABELS:
        expr = expr.when(score >= least, F.lit(label))
    return expr.otherwise(F.lit("insufficient"))
