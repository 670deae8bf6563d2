"""Answer assembly: citations, context, recommendations, confidence, whole answers.

The groups collected here are the ranked chunks of one query, at most k rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import scoring
from claimgrain.functions.terms import contains_any
from claimgrain.functions.text import strip_blank
from claimgrain.operators.safety import evaluate


def _ordered(order: str, value: Column, sep: str) -> Column:
    """Concatenation of ``value`` in ``order`` over one query's rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def excerpt(content: Column) -> Column:
    cut = strip_blank(F.translate(F.substring(content, 1, dims.EXCERPT_CHARS), "\n", " "))
    return F.when(F.length(content) > dims.EXCERPT_CHARS, F.concat(cut, F.lit("…"))).otherwise(cut)


def citations(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """The first ranked chunk of every document, numbered in rank order."""
    source = F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.col("chunk_id"))
    first = Window.partitionBy(key, "source_id").orderBy("rank")
    number = Window.partitionBy(key).orderBy("rank")
    return (ranked.withColumn("source_id", source)
            .withColumn("pos", F.row_number().over(first)).filter("pos = 1").drop("pos")
            .withColumn("number", F.row_number().over(number))
            .withColumn("excerpt", excerpt(F.col("content"))))


def source_line() -> Column:
    """``[n] name — url``, without the url part when there is none."""
    url = F.nullif(F.col("source_url"), F.lit(""))
    return F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("source_name"),
                    F.when(url.isNotNull(), F.concat(F.lit(" — "), url)).otherwise(""))


def sources_block(cited: DataFrame, key: str = "query_id") -> DataFrame:
    return cited.groupBy(key).agg(
        _ordered("number", source_line(), "\n").alias("lines"),
        F.count(F.lit(1)).alias("n_citations")).select(
        key, "n_citations", F.concat(F.lit("\n\n**Sources:**\n"), F.col("lines"))
        .alias("sources"))


def citation_integrity(answers: DataFrame) -> DataFrame:
    """Markers without a citation and citations without a marker.

    Needs ``answer`` and ``n_citations``.
    """
    found = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)),
                        lambda m: F.try_to_number(m, F.lit("9" * 18)).cast("bigint"))
    numbers = F.when(F.col("n_citations") > 0,
                     F.sequence(F.lit(1).cast("bigint"), F.col("n_citations").cast("bigint"))
                     ).otherwise(F.array().cast("array<bigint>"))
    return (answers.withColumn("markers", F.array_distinct(found))
            .withColumn("orphaned", F.array_sort(F.array_except("markers", numbers)))
            .withColumn("unused", F.array_sort(F.array_except(numbers, F.col("markers"))))
            .drop("markers"))


def context_entry() -> Column:
    return F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (Tier "),
                    F.col("evidence_tier").cast("string"), F.lit(", "), F.col("source_name"),
                    F.lit(")\n"), strip_blank(F.col("content")), F.lit("\n"))


def context_block(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbered evidence text per query."""
    return ranked.groupBy(key).agg(_ordered("rank", context_entry(), "\n").alias("context"))


def prompt_body(query: Column, context: Column, case: Column | None = None) -> Column:
    """Query, optional patient lines and evidence, as sent to a model."""
    head = F.concat(F.lit(dims.PROMPT_QUERY), query)
    if case is not None:
        listed = lambda name: F.coalesce(
            F.nullif(F.array_join(case[name], ", "), F.lit("")), F.lit("none"))
        age = F.coalesce(F.nullif(case["age_range"], F.lit("")), F.lit("not specified"))
        lines = F.concat(F.lit(dims.PROMPT_PATIENT), age,
                         F.lit(dims.PROMPT_INDICATIONS), listed("indications"),
                         F.lit(dims.PROMPT_CONTRAINDICATIONS), listed("contraindications"),
                         F.lit("\n"))
        head = F.concat(head, F.when(case.isNotNull(), lines).otherwise(""))
    return F.concat(head, F.lit(dims.PROMPT_EVIDENCE), context)


def offline_answer(query: Column, context: Column) -> Column:
    """The deterministic answer given when no model is at hand."""
    return F.concat(F.lit(dims.OFFLINE_QUERY), query, F.lit(dims.OFFLINE_NOTE), context,
                    F.lit(dims.OFFLINE_END))


def recommendations(answer: Column, limit: int = 5, longer_than: int = 10) -> Column:
    """The first bullet lines of an answer, without their markers."""
    lines = F.transform(F.split(answer, "\n"), strip_blank)
    bullets = F.filter(lines, lambda s: s.rlike("^[-*•→] "))
    texts = F.transform(bullets, lambda s: strip_blank(F.ltrim(s, F.lit("-*•→ "))))
    return F.slice(F.filter(texts, lambda s: F.length(s) > longer_than), 1, limit)


def disclaimer(flags: Column, product: str = "this service") -> Column:
    standard = dims.DISCLAIMER.format(product=product)
    critical = F.exists(flags, lambda f: f["severity"] == "critical")
    return F.when(critical, dims.CRITICAL_NOTICE + standard).otherwise(standard)


def confidence(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Mean tier weight, coverage-adjusted confidence and its label, per query."""
    return (ranked.groupBy(key)
            .agg(F.avg(scoring.tier_weight(F.col("evidence_tier"))).alias("tier_score"),
                 F.count(F.lit(1)).alias("n_chunks"))
            .withColumn("confidence", scoring.confidence(F.col("tier_score"), F.col("n_chunks")))
            .withColumn("label", scoring.confidence_label(F.col("confidence"))))


def tier_phrase(tier: Column, n: Column) -> Column:
    plural = F.when(n == 1, "").otherwise("s")
    return F.concat(n.cast("string"), F.lit(" "), F.lower(scoring.tier_label(tier)),
                    F.lit(" source"), plural)


def confidence_phrase(confidence: Column) -> Column:
    percent = F.bround(confidence * 100, 0).cast("int").cast("string")
    return F.concat(F.lit("Confidence: "), scoring.confidence_label(confidence),
                    F.lit(" ("), percent, F.lit("%)"))


def evidence_summary(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Source counts by tier and the confidence, as one readable line per query."""
    by_tier = ranked.groupBy(key, "evidence_tier").agg(F.count(F.lit(1)).alias("n"))
    weight = scoring.tier_weight(F.col("evidence_tier"))
    per_query = by_tier.groupBy(key).agg(
        _ordered("evidence_tier", tier_phrase(F.col("evidence_tier"), F.col("n")), " | ")
        .alias("parts"),
        F.sum("n").alias("n_chunks"),
        (F.sum(weight * F.col("n")) / F.sum("n")).alias("tier_score"))
    score = scoring.confidence(F.col("tier_score"), F.col("n_chunks"))
    return per_query.withColumn("confidence", score).select(
        key, "n_chunks", "confidence",
        F.concat_ws(" | ", "parts", confidence_phrase(F.col("confidence")))
        .alias("evidence_summary"))


def tiers_used(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    return ranked.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("evidence_tier")), ",").alias("tiers"))


def evidence_per_query(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per query with everything an answer needs from its ranked chunks.

    All parts come from one aggregate: ranking has already placed a query's rows together,
    so numbering and grouping add no shuffle.
    """
    first = Window.partitionBy(key, "source_id").orderBy("rank")
    upto = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    source = F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.col("chunk_id"))
    numbered = (ranked.withColumn("source_id", source)
                .withColumn("is_first", F.row_number().over(first) == 1)
                .withColumn("number", F.count_if("is_first").over(upto)))
    # array_join leaves out the NULL lines of repeated sources
    cited_line = F.when(F.col("is_first"), source_line())
    grouped = numbered.groupBy(key).agg(
        _ordered("rank", context_entry(), "\n").alias("context"),
        _ordered("rank", cited_line, "\n").alias("lines"),
        F.count_if("is_first").alias("n_citations"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg(scoring.tier_weight(F.col("evidence_tier"))).alias("tier_score"),
        F.sort_array(F.collect_list("evidence_tier")).alias("tier_list"),
        F.bool_or(contains_any(F.col("content"), dims.GROWTH_TERMS)).alias("chunks_mention"))
    phrases = F.transform(F.array_distinct("tier_list"), lambda t: tier_phrase(
        t, F.size(F.filter("tier_list", lambda x: x == t))))
    score = scoring.confidence(F.col("tier_score"), F.col("n_chunks"))
    return grouped.withColumn("confidence", score).select(
        key, "context", F.concat(F.lit("\n\n**Sources:**\n"), F.col("lines")).alias("sources"),
        "n_citations", "n_chunks", "confidence", "chunks_mention",
        F.array_join(F.transform(F.array_distinct("tier_list"), lambda t: t.cast("string")), ",")
        .alias("tiers"),
        F.concat_ws(" | ", F.array_join(phrases, " | "), confidence_phrase(F.col("confidence")))
        .alias("evidence_summary"))


def batch_answers(requests: DataFrame, evidence: DataFrame, product: str = "this service") -> DataFrame:
    """One finished answer per request.

    ``evidence`` has one row per distinct query text, so the join is many to one; a query
    asked by a third of all requests is split by the skew-join rule, never grouped.
    """
    joined = requests.join(evidence, "query_id", "left")
    flagged = evaluate(joined)
    context = F.coalesce(F.col("context"), F.lit(dims.NO_CONTEXT))
    answer = offline_answer(F.col("query"), context)
    return (flagged
            .withColumn("answer", F.concat(answer, F.coalesce("sources", F.lit(""))))
            .withColumn("recommendations", recommendations(F.col("answer")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
            .withColumn("label", scoring.confidence_label(F.col("confidence")))
            .withColumn("evidence_summary", F.coalesce("evidence_summary", F.lit(dims.NO_EVIDENCE)))
            .withColumn("n_citations", F.coalesce("n_citations", F.lit(0).cast("bigint")))
            .withColumn("tiers", F.coalesce("tiers", F.lit("")))
            .withColumn("disclaimer", disclaimer(F.col("flags"), product)))
