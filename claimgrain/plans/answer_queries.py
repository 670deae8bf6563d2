"""Safety, citation, confidence and whole-answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions.terms import matched_terms
from claimgrain.operators import answers, safety
from claimgrain.operators.audit import chat_events, gate_events
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.plans.retrieval_queries import ranked_chunks, ranked_tiers
from claimgrain.sources import adapters as ad


def _ranked(spark, sf):
    queries = ad.distinct_queries(ad.requests(spark, sf))
    return ranked_chunks(spark, sf, queries, q.RANK_K)


def _ranked_tiers(spark, sf):
    queries = ad.distinct_queries(ad.requests(spark, sf))
    return ranked_tiers(spark, sf, queries, q.RANK_K)


_GROWN = f"""mention AS (
  SELECT query_id, bool_or({q.has_any('content', dims.GROWTH_TERMS)}) AS mentions FROM ranked GROUP BY query_id)"""


def _case_any(terms):
    return (f"(has_case AND (len(list_filter(contraindications, lambda x: {q.has_any('x', terms)})) > 0 "
            f"OR {q.has_any('indication', terms)}))")


def _rule(code, condition, message=None):
    severity, text_, rationale = dims.SAFETY_RULES[code]
    return (f"SELECT request_id, '{code}' AS code, '{severity}' AS severity, "
            f"{message or q.lit(text_)} AS message, {q.lit(rationale)} AS rationale FROM facts WHERE {condition}")


_FACTS = f"""facts AS (
  SELECT r.*, ({q.has_any('r.query', dims.PREGNANCY_TERMS)} OR {_case_any(dims.PREGNANCY_TERMS)}) AS preg,
    ({q.has_any('r.query', dims.ONCOLOGY_TERMS)} OR {_case_any(dims.ONCOLOGY_TERMS)}) AS onco,
    ({q.has_any('r.query', dims.GROWTH_TERMS)} OR COALESCE(m.mentions, false)) AS growth
  FROM requests r LEFT JOIN mention m ON m.query_id = r.query_id)"""
_MEDS = dims.SAFETY_RULES["SR-004"][1]
_FLAGS = " UNION ALL ".join([
    _rule("SR-001", "preg"), _rule("SR-002", "onco AND growth"),
    _rule("SR-003", "has_case AND no_labs"),
    _rule("SR-004", "has_case AND n_drugs >= 3", f"printf({q.lit(_MEDS)}, n_drugs)")])


def _evaluated(spark, sf):
    requests = ad.requests(spark, sf)
    mention = safety.mentions_growth(_ranked(spark, sf))
    return safety.evaluate(requests.join(mention, "query_id", "left"))


@register("safety_flags", q.query(f"{q.RANKED},\n{_GROWN},\n{_FACTS}", _FLAGS))
def safety_flags(spark, sf):
    return _evaluated(spark, sf).select("request_id", F.inline("flags")).select(
        "request_id", "code", "severity", "message", "rationale")


@register("safety_matched_terms", q.query(q.DOCS, f"""
SELECT doc_id, array_to_string(list_filter({q.strings(dims.GROWTH_TERMS)},
  lambda t: contains(lower(raw_content), t)), ',') AS growth,
  array_to_string(list_filter({q.strings(dims.ONCOLOGY_TERMS)},
  lambda t: contains(lower(raw_content), t)), ',') AS oncology FROM docs"""))
def safety_matched_terms(spark, sf):
    content = F.col("raw_content")
    return ad.docs_meta(spark, sf).select(
        "doc_id", F.array_join(matched_terms(content, dims.GROWTH_TERMS), ",").alias("growth"),
        F.array_join(matched_terms(content, dims.ONCOLOGY_TERMS), ",").alias("oncology"))


@register("access_gate", q.query(q.REQUESTS, """
SELECT request_id, role, CASE WHEN restricted AND (request_id % 5 = 0 OR role = 'researcher')
    THEN 'deny' ELSE 'allow' END AS decision,
  CASE WHEN NOT restricted THEN 'not requested' WHEN request_id % 5 = 0 THEN 'feature flag is off'
    WHEN role = 'researcher' THEN 'role not permitted: researcher' ELSE 'permitted' END AS reason
FROM requests"""))
def access_gate(spark, sf):
    gated = safety.access_gate(ad.request_roles(spark, sf), F.col("request_id") % 5 != 0)
    return gated.select("request_id", "role", "decision", "reason")


@register("condition_rules", q.query(q.REQUESTS, f"""
SELECT DISTINCT request_id, condition, {q.case_of('condition', dims.CONDITION_SEVERITY, 'NULL')} AS severity
FROM (SELECT request_id, unnest(list_transform(contraindications, lambda c: lower(c))) AS condition
  FROM requests WHERE has_case AND {q.has_any('query', dims.GROWTH_TERMS)})
WHERE condition IN {q.in_list(dims.CONDITION_SEVERITY)}"""))
def condition_rules(spark, sf):
    return safety.condition_flags(ad.requests(spark, sf))


_SOURCE = "COALESCE(NULLIF(document_id, ''), chunk_id)"
_EXCERPT = f"""{q.strip("translate(substr(content, 1, 300), chr(10), ' ')")} || CASE WHEN length(content) > 300 THEN '…' ELSE '' END"""
_CITED = f"""cited AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number FROM (
    SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, {_SOURCE} ORDER BY rank) = 1))"""


@register("citations", q.query(f"{q.RANKED},\n{_CITED}", f"""
SELECT query_id, number, {_SOURCE} AS source_id, source_name, source_url, chunk_id, evidence_tier,
  {_EXCERPT} AS excerpt FROM cited"""))
def citations(spark, sf):
    cited = answers.citations(_ranked(spark, sf))
    return cited.select("query_id", F.col("number").cast("bigint").alias("number"), "source_id",
                        "source_name", "source_url", "chunk_id", "evidence_tier", "excerpt")


_SOURCES = """sources AS (
  SELECT query_id, count(*) AS n_citations, chr(10) || chr(10) || '**Sources:**' || chr(10) || string_agg(
    '[' || number || '] ' || source_name || CASE WHEN source_url IS NOT NULL THEN ' — ' || source_url ELSE '' END,
    chr(10) ORDER BY number) AS sources FROM cited GROUP BY query_id)"""


@register("sources_block", q.query(f"{q.RANKED},\n{_CITED},\n{_SOURCES}", "SELECT * FROM sources"))
def sources_block(spark, sf):
    return answers.sources_block(answers.citations(_ranked(spark, sf)))


@register("citation_integrity", """
WITH a AS (SELECT doc_id, doc_id % 5 AS n, [1, doc_id % 7, doc_id % 4] AS ms FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(ms, lambda m: m < 1 OR m > n))), ',') AS orphaned,
  array_to_string(list_filter(range(1, n + 1), lambda i: NOT list_contains(ms, i)), ',') AS unused FROM a""")
def citation_integrity(spark, sf):
    doc = F.col("doc_id")
    marked = F.concat(F.lit("[1] "), "text", F.lit(" ["), (doc % 7).cast("string"), F.lit("] and ["),
                      (doc % 4).cast("string"), F.lit("]"))
    rows = ad.table(spark, sf, "documents").select(
        "doc_id", marked.alias("answer"), (doc % 5).alias("n_citations"))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return answers.citation_integrity(rows).select(
        "doc_id", as_text("orphaned").alias("orphaned"), as_text("unused").alias("unused"))


_CONTEXT = f"""context AS (
  SELECT query_id, string_agg('[Source ' || rank || '] (Tier ' || evidence_tier || ', ' || source_name || ')'
    || chr(10) || {q.strip('content')} || chr(10), chr(10) ORDER BY rank) AS context
  FROM ranked GROUP BY query_id)"""


@register("context_block", q.query(f"{q.RANKED},\n{_CONTEXT}", "SELECT * FROM context"))
def context_block(spark, sf):
    return answers.context_block(_ranked(spark, sf))


@register("prompt_body", q.query(f"{q.RANKED},\n{_CONTEXT}", """
SELECT r.request_id, substr(sha256(encode('Clinical Query: ' || r.query || CASE WHEN has_case THEN
  '\n\nPatient Context (de-identified):\n  Age range: 40-49\n  Indications: ' || indication
  || '\n  Contraindications: ' || CASE WHEN len(contraindications) = 0 THEN 'none'
     ELSE array_to_string(contraindications, ', ') END || '\n' ELSE '' END
  || '\n\nEvidence Context:\n' || c.context)), 1, 16) AS prompt_hash
FROM requests r JOIN context c USING (query_id)"""))
def prompt_body(spark, sf):
    from claimgrain.functions.ids import query_hash
    joined = ad.requests(spark, sf).join(answers.context_block(_ranked(spark, sf)), "query_id")
    prompt = answers.prompt_body(F.col("query"), F.col("context"), F.col("case"))
    return joined.select("request_id", query_hash(prompt).alias("prompt_hash"))


_BULLET = "'^[-*•→] '"


@register("recommendations", f"""
WITH a AS (SELECT doc_id, list_transform(regexp_split_to_array(
    replace(text, chr(10), chr(10) || (['- ', '* ', '• ', '→ '])[1 + CAST(doc_id % 4 AS INT)]), chr(10)), lambda s: {q.strip('s')}) AS lines
  FROM documents),
b AS (SELECT doc_id, list_transform(list_filter(lines, lambda s: regexp_matches(s, {_BULLET})),
  lambda s: {q.strip("ltrim(s, '-*•→ ')")}) AS recs FROM a)
SELECT doc_id, array_to_string((list_filter(recs, lambda s: length(s) > 10))[1:5], chr(10)) AS recommendations FROM b""")
def recommendations(spark, sf):
    marks = F.array(*map(F.lit, ["\n- ", "\n* ", "\n• ", "\n→ "]))
    mark = F.get(marks, (F.col("doc_id") % 4).cast("int"))
    answer = F.replace(F.col("text"), F.lit("\n"), mark)
    return ad.table(spark, sf, "documents").select(
        "doc_id", F.array_join(answers.recommendations(answer), "\n").alias("recommendations"))


_CONF = f"""conf AS (
  SELECT *, {q.label('confidence')} AS label FROM (
    SELECT query_id, n_chunks, tier_score, round(least(1.0, tier_score * {q.coverage('n_chunks')}), 4) AS confidence
    FROM (SELECT query_id, count(*) AS n_chunks, round(avg({q.weight()}), 9) AS tier_score FROM ranked GROUP BY query_id)))"""


@register("confidence", q.query(f"{q.RANKED},\n{_CONF}", """
SELECT query_id, n_chunks, round(tier_score, 6) AS tier_score, confidence, label FROM conf"""))
def confidence(spark, sf):
    return answers.confidence(_ranked_tiers(spark, sf)).withColumn("tier_score", F.round("tier_score", 6))


_SUMMARY = f"""summary AS (
  SELECT t.query_id, string_agg(t.n || ' ' || lower({q.case_of('t.evidence_tier', dims.TIER_LABELS, "'Tier'")})
    || ' source' || CASE WHEN t.n = 1 THEN '' ELSE 's' END, ' | ' ORDER BY t.evidence_tier)
    || ' | Confidence: ' || any_value(c.label) || ' (' || CAST(round_even(any_value(c.confidence) * 100, 0) AS INT) || '%)' AS evidence_summary
  FROM (SELECT query_id, evidence_tier, count(*) AS n FROM ranked GROUP BY ALL) t JOIN conf c USING (query_id)
  GROUP BY t.query_id)"""


@register("evidence_summary", q.query(f"{q.RANKED},\n{_CONF},\n{_SUMMARY}", """
SELECT query_id, n_chunks, confidence, evidence_summary FROM conf JOIN summary USING (query_id)"""))
def evidence_summary(spark, sf):
    return answers.evidence_summary(_ranked_tiers(spark, sf))


@register("tiers_used", q.query(q.RANKED, """
SELECT query_id, string_agg(DISTINCT evidence_tier, ',' ORDER BY evidence_tier) AS tiers FROM ranked GROUP BY query_id"""))
def tiers_used(spark, sf):
    return answers.tiers_used(_ranked_tiers(spark, sf))


@register("low_tier_only", q.query(q.RANKED, """
SELECT query_id, min(evidence_tier) AS best_tier, count(*) AS sources, min(evidence_tier) >= 4 AS low_tier_only
FROM ranked GROUP BY query_id"""))
def low_tier_only(spark, sf):
    return safety.low_tier_only(_ranked_tiers(spark, sf))


_DISC = dims.DISCLAIMER.format(product="this service")


_TIERS = """tiers AS (
  SELECT query_id, string_agg(DISTINCT evidence_tier, ',' ORDER BY evidence_tier) AS tiers FROM ranked GROUP BY query_id)"""
_ALL = ",\n".join([q.RANKED, _GROWN, _FACTS, _CITED, _SOURCES, _CONTEXT, _CONF, _SUMMARY, _TIERS,
                   f"flags AS ({_FLAGS})"])


def _answered(spark, sf):
    evidence = answers.evidence_per_query(_ranked(spark, sf))
    return answers.batch_answers(ad.requests(spark, sf), evidence)


@register("batch_answers", q.query(_ALL, f"""
SELECT r.request_id, r.role, '**Query:** ' || r.query || '\n\n**Note:** LLM synthesis is currently unavailable. '
    || 'The following evidence was retrieved:\n\n' || c.context || '\n\nPlease review the cited sources directly.'
    || s.sources AS answer,
  COALESCE(f.codes, '') AS flags, conf.confidence, conf.label, summary.evidence_summary, s.n_citations,
  CASE WHEN f.critical THEN {q.lit(dims.CRITICAL_NOTICE + _DISC)} ELSE {q.lit(_DISC)} END AS disclaimer
FROM requests r JOIN context c USING (query_id) JOIN sources s USING (query_id) JOIN conf USING (query_id)
  JOIN summary USING (query_id)
  LEFT JOIN (SELECT request_id, string_agg(code, ',' ORDER BY code) AS codes,
    bool_or(severity = 'critical') AS critical FROM flags GROUP BY request_id) f USING (request_id)"""))
def batch_answers(spark, sf):
    return _answered(spark, sf).select(
        "request_id", "role", "answer",
        F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("flags"),
        "confidence", "label", "evidence_summary", "n_citations", "disclaimer")


@register("chat_log", q.query(_ALL, """
SELECT r.request_id, r.role, r.query_id AS query_hash, COALESCE(f.codes, '') AS safety_flags, conf.confidence,
  s.n_citations AS citations, t.tiers AS source_tiers_used
FROM requests r JOIN sources s USING (query_id) JOIN conf USING (query_id) JOIN tiers t USING (query_id)
  LEFT JOIN (SELECT request_id, string_agg(code, ',' ORDER BY code) AS codes FROM flags GROUP BY request_id) f USING (request_id)"""))
def chat_log(spark, sf):
    """Audit rows of all answered requests, read back from their JSON payload."""
    events = chat_events(_answered(spark, sf), ad.ntz(ad.RUN_AT))
    p = F.from_json("data", "query_hash string, confidence double, safety_flags array<string>, "
                            "citations bigint, source_tiers_used string")
    return events.select("request_id", "role", p.alias("p")).select(
        "request_id", "role", "p.query_hash", F.array_join("p.safety_flags", ",")
        .alias("safety_flags"), "p.confidence", "p.citations", "p.source_tiers_used")


@register("gate_log", q.query(q.REQUESTS, f"""
SELECT request_id, role, '{ad.RUN_AT}' AS logged_at, 'access_denied' AS event_type,
  '{{"rule":"SR-005","decision":"deny","reason":"role not permitted: researcher"}}' AS data
FROM requests WHERE restricted AND role = 'researcher'"""))
def gate_log(spark, sf):
    gated = safety.access_gate(ad.request_roles(spark, sf), F.lit(True))
    return gate_events(gated, ad.ntz(ad.RUN_AT)).select(
        "request_id", "role", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
        "event_type", "data")
