"""Claim, triple and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.operators import graph, knowledge, mentions
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.session import stored
from claimgrain.sources import adapters as ad
from claimgrain.sources import files

_CLAIMS = """claims AS (
  SELECT 'c' || doc_id AS source_chunk_id, CAST(doc_id % 5 + 1 AS INT) AS evidence_tier, position,
    CASE position WHEN 0 THEN text ELSE source END AS claim_text, lang,
    CASE position WHEN 0 THEN 0.85 ELSE 0.5 END AS confidence
  FROM documents CROSS JOIN (VALUES (0), (1)) p(position) WHERE doc_id % 4 <> 3)"""


@register("parse_claims", q.query(_CLAIMS, """
SELECT source_chunk_id, evidence_tier, position, claim_text, lang AS condition, CAST(confidence AS DOUBLE) AS confidence
FROM claims"""))
def parse_claims(spark, sf):
    return knowledge.parse_claims(ad.responses(spark, sf)).select(
        "source_chunk_id", "evidence_tier", "position", "claim_text",
        F.array_join("condition_mentioned", ",").alias("condition"), "confidence")


@register("unparsed_responses", """
SELECT 'c' || doc_id AS chunk_id FROM documents WHERE doc_id % 4 = 3""")
def unparsed_responses(spark, sf):
    return knowledge.unparsed_responses(ad.responses(spark, sf)).select("chunk_id")


@register("claim_lines", q.query(_CLAIMS, """
SELECT source_chunk_id, string_agg('- [' || evidence_tier || '] ' || claim_text, chr(10) ORDER BY position) AS claims_text
FROM claims WHERE claim_text <> '' GROUP BY source_chunk_id"""))
def claim_lines(spark, sf):
    return knowledge.claim_lines(knowledge.parse_claims(ad.responses(spark, sf)))


_PART_TRIPLES = f"""
SELECT 'p' || p_partkey AS source_chunk_id, p_brand AS subject,
  ({q.strings(dims.RELATIONS)})[1 + CAST(p_partkey % 12 AS INT)] AS relation, p_name AS object,
  p_size % 10 / 10.0 AS confidence
FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 12 <> 11"""


@register("parse_triples", _PART_TRIPLES)
def parse_triples(spark, sf):
    return knowledge.parse_triples(ad.triple_responses(spark, sf)).select(
        "source_chunk_id", "subject", "relation", "object", "confidence")


@register("confident_triples", _PART_TRIPLES + " AND p_size % 10 / 10.0 >= 0.4")
def confident_triples(spark, sf):
    return knowledge.parse_triples(ad.triple_responses(spark, sf),
                                   dims.TRIPLE_CONFIDENCE_FLOOR).select(
        "source_chunk_id", "subject", "relation", "object", "confidence")


@register("load_triples", """
SELECT p_brand AS subject, (%s)[1 + CAST(p_partkey %% 12 AS INT)] AS relation, p_name AS object,
  p_size %% 10 / 10.0 AS confidence FROM part WHERE p_partkey %% 5 <> 0""" % q.strings([*dims.RELATIONS, "RELATED_TO"]))
def load_triples(spark, sf):
    """Triple files as stored after extraction, one per part; every fifth is cut short."""
    stored_files = ad.triple_files(spark, sf)
    return files.load_triples(stored_files).select("subject", "relation", "object", "confidence")


@register("link_entities", q.query(q.TRIPLES, """
SELECT subject, relation, object, count(*) AS triples FROM triples GROUP BY ALL"""))
def link_entities(spark, sf):
    return ad.linked_triples(spark, sf).groupBy("subject", "relation", "object").agg(
        F.count(F.lit(1)).alias("triples"))


@register("graph_edges", q.query(q.EDGES, "SELECT * FROM edges"))
def graph_edges(spark, sf):
    return ad.edges(spark, sf)


@register("graph_nodes", q.query(q.TRIPLES, """
SELECT id, arg_max(kind, ord) AS entity_type FROM (
  SELECT subject AS id, subject_type AS kind, seq * 2 AS ord FROM triples
  UNION ALL SELECT object, object_type, seq * 2 + 1 FROM triples) GROUP BY id"""))
def graph_nodes(spark, sf):
    return graph.build_nodes(ad.linked_triples(spark, sf))


@register("graph_counts", q.query(q.TRIPLES, """
SELECT 'edges' AS kind, count(DISTINCT (subject, object)) AS total FROM triples
UNION ALL SELECT 'nodes', count(DISTINCT id) FROM (SELECT subject AS id FROM triples UNION ALL SELECT object FROM triples)"""))
def graph_counts(spark, sf):
    return graph.graph_counts(ad.linked_triples(spark, sf))


_BOTH = """
SELECT src AS entity, dst AS neighbor, 'outgoing' AS direction, relation, evidence_tier, confidence FROM edges %s
UNION ALL SELECT dst, src, 'incoming', relation, evidence_tier, confidence FROM edges %s"""


def _neighbors(spark, sf, relation=None):
    """Every entity asks; edges are made once and stored."""
    edges = stored(ad.edges(spark, sf), "edges")
    entities = edges.select(F.explode(F.array("src", "dst")).alias("entity"))
    return graph.neighbors(edges, entities, relation)


@register("graph_neighbors", q.query(q.EDGES, _BOTH % ("", "")))
def graph_neighbors(spark, sf):
    return _neighbors(spark, sf)


_ONLY = "WHERE relation = 'CONTRAINDICATED_WITH'"


@register("contraindications", q.query(q.EDGES, _BOTH % (_ONLY, _ONLY)))
def contraindications(spark, sf):
    return _neighbors(spark, sf, dims.CONTRAINDICATION)


@register("evidence_paths", q.query(q.EDGES + """,
pairs AS (SELECT DISTINCT dst AS source, src AS target FROM edges WHERE relation = 'CONTRAINDICATED_WITH' AND src <> dst),
l AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
p1 AS (SELECT source, target, [source, dst] AS path, dst AS tip FROM pairs JOIN l ON src = source),
p2 AS (SELECT source, target, list_append(path, dst) AS path, dst AS tip FROM p1 JOIN l ON src = tip
  WHERE tip <> target AND NOT list_contains(path, dst)),
p3 AS (SELECT source, target, list_append(path, dst) AS path, dst AS tip FROM p2 JOIN l ON src = tip
  WHERE tip <> target AND NOT list_contains(path, dst)),
short AS (SELECT source, target, path FROM p1 WHERE tip = target UNION ALL SELECT source, target, path FROM p2 WHERE tip = target
  UNION ALL SELECT source, target, path FROM p3 WHERE tip = target),
few AS (SELECT source, target FROM pairs EXCEPT SELECT source, target FROM short GROUP BY ALL HAVING count(*) >= 5),
p4 AS (SELECT source, target, list_append(path, dst) AS path FROM p3 JOIN few USING (source, target) JOIN l ON src = tip AND dst = target
  WHERE tip <> target),
found AS (SELECT * FROM short UNION ALL SELECT * FROM p4)""", """
SELECT source, target, len(path) - 1 AS hops, array_to_string(path, ' > ') AS path,
  row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS path_rank
FROM found QUALIFY path_rank <= 5"""))
def evidence_paths(spark, sf):
    """Paths back from the object of every contraindication to its subject."""
    edges = stored(ad.edges(spark, sf), "edges")
    pairs = edges.filter(F.col("relation") == dims.CONTRAINDICATION).select(
        F.col("dst").alias("source"), F.col("src").alias("target"))
    return graph.evidence_paths(edges, pairs).select(
        "source", "target", F.col("hops").cast("bigint").alias("hops"),
        F.array_join("path", " > ").alias("path"),
        F.col("path_rank").cast("bigint").alias("path_rank"))


@register("edge_export", q.query(q.EDGES, """
SELECT '{"source":"' || src || '","target":"' || dst || '","relation":"' || relation || '","evidence_tier":' || evidence_tier
  || ',"source_chunk_id":"' || source_chunk_id || '","confidence":' || confidence || '}' AS value FROM edges"""))
def edge_export(spark, sf):
    return graph.edge_lines(ad.edges(spark, sf))


_NAMES = [(n.lower(), canonical) for canonical, names in dims.SYNONYMS.items() for n in [canonical, *names]]
_LISTED = sorted({t for t in (*dims.GROWTH_TERMS, *dims.PREGNANCY_TERMS, *dims.ONCOLOGY_TERMS)} - {n for n, _ in _NAMES})
_BORDER = r"(?:$|[^\pL\pN_])"


@register("entity_mentions", q.query(f"{q.DOCS},\n{q.REQUESTS}" + f""",
names(name, canonical) AS (VALUES {", ".join(f"({q.lit(n)}, {q.lit(c)})" for n, c in
                                             [*_NAMES, *((t, t) for t in _LISTED)])}),
texts AS (SELECT 'doc ' || doc_id AS id, raw_content AS text FROM docs
  UNION ALL SELECT 'request ' || request_id, query FROM requests),
hits AS (SELECT id, canonical, len(regexp_extract_all(lower(text),
    '(?:^|[^\\pL\\pN_])' || regexp_escape(name) || '{_BORDER}')) AS n
  FROM texts JOIN names ON contains(lower(text), name))""", """
SELECT id, canonical, CAST(sum(n) AS BIGINT) AS mentions FROM hits WHERE n > 0 GROUP BY id, canonical"""))
def entity_mentions(spark, sf):
    """Entities and listed terms in whole documents and requests."""
    listed = spark.createDataFrame([(t, t, False) for t in _LISTED], "name string, canonical string, ambiguous boolean")
    names = knowledge.entity_names(spark).unionByName(listed)
    docs = ad.docs_meta(spark, sf).select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), F.col("raw_content").alias("text"))
    asked = ad.requests(spark, sf).select(
        F.concat(F.lit("request "), F.col("request_id").cast("string")).alias("id"), F.col("query").alias("text"))
    found = mentions.find_mentions(docs.unionByName(asked), names, key="id", text="text")
    return found.select("id", F.explode("mentions.canonical").alias("canonical")).groupBy("id", "canonical").agg(
        F.count(F.lit(1)).alias("mentions"))


@register("misspelt_names", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part),
words AS (SELECT DISTINCT CASE p_partkey % 3
    WHEN 0 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)) || substr(p_name, CAST(p_partkey % length(p_name) AS INT) + 2)
    WHEN 1 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)) || 'q' || substr(p_name, CAST(p_partkey % length(p_name) AS INT) + 1)
    ELSE p_name END AS word FROM part)
SELECT word, name, CAST(levenshtein(word, name) AS INTEGER) AS edits FROM words JOIN names
  ON abs(length(word) - length(name)) <= 1 AND levenshtein(word, name) <= 1""")
def misspelt_names(spark, sf):
    """Part names with a letter lost or added, traced to all names one edit away."""
    parts, name = ad.table(spark, sf, "part"), F.col("p_name")
    at = (F.col("p_partkey") % F.char_length(name)).cast("int")
    head = F.substring(name, F.lit(1), at)
    tail = lambda skip: F.substring(name, at + skip, F.char_length(name))
    word = (F.when(F.col("p_partkey") % 3 == 0, F.concat(head, tail(2)))
            .when(F.col("p_partkey") % 3 == 1, F.concat(head, F.lit("q"), tail(1))).otherwise(name))
    return knowledge.misspelt_names(parts.select(word.alias("word")), parts.select(name.alias("name")))


@register("graph_rank")
def graph_rank(spark, sf):
    """The entities around every contraindicated one, by walks that start there."""
    edges = stored(ad.edges(spark, sf), "edges")
    seeds = edges.filter(F.col("relation") == dims.CONTRAINDICATION).select(
        F.col("src").alias("query_id"), F.col("src").alias("node"), F.lit(1.0).alias("weight")).distinct()
    return graph.personalised_rank(edges, seeds)
