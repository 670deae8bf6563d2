"""Safety rules over requests, patient cases and retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions.terms import any_contains, contains_any

FLAG = "struct<code:string,severity:string,message:string,rationale:string>"


def mentions_growth(chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """Per query: does any retrieved chunk mention a growth-signalling substance?"""
    return chunks.groupBy(key).agg(
        F.bool_or(contains_any(F.col("content"), dims.GROWTH_TERMS)).alias("chunks_mention"))


def case_texts(case: str = "case") -> Column:
    """The case fields that rules read: contraindications, indications, notes."""
    field = lambda name: F.coalesce(F.col(f"{case}.{name}"), F.array().cast("array<string>"))
    note = F.col(f"{case}.notes")
    notes = F.when(F.coalesce(note, F.lit("")) != "", F.array(note)).otherwise(
        F.array().cast("array<string>"))
    return F.concat(field("contraindications"), field("indications"), notes)


def _flag(code: str, fired: Column, message: Column | None = None) -> Column:
    severity, text, rationale = dims.SAFETY_RULES[code]
    return F.when(fired, F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        (F.lit(text) if message is None else message).alias("message"),
        F.lit(rationale).alias("rationale")).cast(FLAG))


def evaluate(requests: DataFrame) -> DataFrame:
    """Adds ``flags``, the fired rules in code order.

    Needs ``query``, ``case`` (struct, may be NULL) and ``chunks_mention`` (boolean).
    """
    has_case = F.col("case").isNotNull()
    in_case = lambda terms: has_case & any_contains(case_texts(), terms)
    pregnancy = contains_any(F.col("query"), dims.PREGNANCY_TERMS) | in_case(dims.PREGNANCY_TERMS)
    oncology = contains_any(F.col("query"), dims.ONCOLOGY_TERMS) | in_case(dims.ONCOLOGY_TERMS)
    growth = (contains_any(F.col("query"), dims.GROWTH_TERMS)
              | F.coalesce(F.col("chunks_mention"), F.lit(False)))
    no_labs = has_case & (F.coalesce(F.size("case.baseline_labs"), F.lit(0)) <= 0)
    n_drugs = F.coalesce(F.size("case.current_medications"), F.lit(0))
    many = has_case & (n_drugs >= dims.POLYPHARMACY_COUNT)
    rules = F.array(
        _flag("SR-001", pregnancy),
        _flag("SR-002", oncology & growth),
        _flag("SR-003", no_labs),
        _flag("SR-004", many, F.format_string(dims.SAFETY_RULES["SR-004"][1], n_drugs)))
    return requests.withColumn("flags", F.filter(rules, lambda r: r.isNotNull()))


def access_gate(requests: DataFrame, feature_enabled: Column) -> DataFrame:
    """Decision on restricted guidance: not requested, feature off, role not allowed."""
    asked = F.coalesce(F.col("restricted"), F.lit(False))
    allowed = F.col("role").isin(dims.PRIVILEGED_ROLES)
    return (requests
            .withColumn("decision", F.when(~asked, "allow").when(~feature_enabled, "deny")
                        .when(~allowed, "deny").otherwise("allow"))
            .withColumn("reason", F.when(~asked, "not requested")
                        .when(~feature_enabled, "feature flag is off")
                        .when(~allowed, F.concat(F.lit("role not permitted: "), F.col("role")))
                        .otherwise("permitted")))


def low_tier_only(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Per query: best tier used, and whether only tier 4 or 5 evidence was found."""
    return (ranked.groupBy(key)
            .agg(F.min("evidence_tier").alias("best_tier"), F.count(F.lit(1)).alias("sources"))
            .withColumn("low_tier_only", F.col("best_tier") >= 4))


def condition_flags(requests: DataFrame) -> DataFrame:
    """One row per request and listed condition, for requests naming a growth substance."""
    severity = F
    for name, level in dims.CONDITION_SEVERITY.items():
        severity = severity.when(F.col("condition") == name, F.lit(level))
    return (requests.filter(contains_any(F.col("query"), dims.GROWTH_TERMS))
            .select("request_id", F.explode(F.array_distinct(F.transform(
                F.col("case.contraindications"), lambda c: F.lower(F.trim(c))))).alias("condition"))
            .withColumn("severity", severity).filter(F.col("severity").isNotNull()))
