"""SQL fragments for the oracle: the adapter and operator rules as DuckDB expressions."""

from __future__ import annotations

import uuid

from claimgrain import dims
from claimgrain.functions import text
from claimgrain.sources import adapters as ad


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {lit(text.BLANK_CHARS)})"


def sub(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def norm(e: str) -> str:
    return strip(sub(sub(e, r"[ \t\x{a0}\x{200b}\x{feff}]+", " "), r"\n{3,}", "\n\n"))


# Written out here, not taken from the code under test, so that a wrong pattern shows.
_BLANK = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}]")
_BOILERPLATE = [
    r"accept all cookies?[^\n]*\n?", r"privacy policy[^\n]*\n?",
    r"terms (of service|and conditions)[^\n]*\n?", r"cookie (policy|notice|settings)[^\n]*\n?",
    r"subscribe to our newsletter[^\n]*\n?", r"all rights reserved[^\n]*\n?",
    r"copyright \d{4}[^\n]*\n?", r"skip to (main )?content[^\n]*\n?",
    rf"menu{_BLANK}*(?:\n|$)", rf"^{_BLANK}*share (this|article|post)[^\n]*\n?"]
_ELEMENTS = [
    r"(?is)<script([\s/][^>]*)?>.*?</script\s*>", r"(?is)<style([\s/][^>]*)?>.*?</style\s*>",
    r"(?is)<nav([\s/][^>]*)?>.*?</nav\s*>", r"(?is)<footer([\s/][^>]*)?>.*?</footer\s*>",
    r"(?is)<header([\s/][^>]*)?>.*?</header\s*>"]
_PARAGRAPH_END = r"\n" + _BLANK + r"*\n"
_MARKUP = r"(?s)<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>"
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"),
               ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def boiler(e: str) -> str:
    for pattern in _BOILERPLATE:
        e = sub(e, "(?im)" + pattern)
    return e


def html(e: str) -> str:
    for pattern in _ELEMENTS:
        e = sub(e, pattern, "<br>")
    nodes = f"list_transform(regexp_split_to_array({e}, {lit(_MARKUP)}), lambda x: {strip('x')})"
    out = f"array_to_string(list_filter({nodes}, lambda x: x <> ''), ' ')"
    for entity, char in _REFERENCES:
        out = f"replace({out}, {lit(entity)}, {lit(char)})"
    return out


def words(e: str) -> str:
    return (f"CASE WHEN {strip(e)} = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE regexp_split_to_array({strip(e)}, {lit(_BLANK + '+')}) END")


def paras(e: str) -> str:
    parts = f"list_transform(regexp_split_to_array({e}, {lit(_PARAGRAPH_END)}), lambda x: {strip('x')})"
    return f"list_filter({parts}, lambda x: x <> '')"


def uuid5(namespace: uuid.UUID, name: str) -> str:
    h = f"sha1(unhex('{namespace.hex}') || encode({name}))"
    return (f"concat_ws('-', substr({h},1,8), substr({h},9,4), '5' || substr({h},14,3), "
            f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h},18,3), "
            f"substr({h},21,12))")


def iso(ts: str) -> str:
    return (f"CASE WHEN date_part('microsecond', {ts}) % 1000000 = 0 "
            f"THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def sha(e: str) -> str:
    return f"sha256(encode({e}))"


def document_id(discriminator: str | None = None) -> str:
    seed = f"source_name || '::' || {iso('acquired_at')}"
    if discriminator:
        seed += f" || '::' || {discriminator}"
    return (f"CASE WHEN source_url IS NOT NULL THEN {uuid5(uuid.NAMESPACE_URL, 'source_url')} "
            f"ELSE {uuid5(uuid.NAMESPACE_DNS, seed)} END")


def case_of(e: str, table: dict, default: str) -> str:
    def value(v):
        return lit(v) if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in table.items())
    return f"CASE {e} {whens} ELSE {default} END"


def tier(kind: str = "source_type", name: str = "source_name") -> str:
    named = " OR ".join(f"contains(lower({name}), {lit(n)})" for n in dims.TIER_ONE_NAMES)
    return f"CASE WHEN {named} THEN 1 ELSE {case_of(f'lower({kind})', dims.SOURCE_TYPE_TIERS, '3')} END"


def weight(e: str = "evidence_tier") -> str:
    return f"CAST({case_of(e, dims.TIER_WEIGHTS, str(dims.DEFAULT_TIER_WEIGHT))} AS DOUBLE)"


def recency(e: str = "published_at") -> str:
    days = f"floor((epoch(TIMESTAMP '{ad.AS_OF}') - epoch({e})) / 86400)"
    return (f"CASE WHEN {e} IS NULL THEN 1.0 WHEN {days} / 365.25 <= 2 THEN 1.0 "
            f"WHEN {days} / 365.25 <= 5 THEN 0.9 ELSE 0.75 END")


def score(similarity: str = "similarity") -> str:
    return (f"round({weight()} * COALESCE({similarity}, 0.5) * CAST({recency()} AS DOUBLE), 9)")


def label(e: str) -> str:
    whens = " ".join(f"WHEN {e} >= {v} THEN {lit(n)}" for v, n in dims.CONFIDENCE_LABELS)
    return f"CASE {whens} ELSE 'insufficient' END"


def coverage(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} >= {n} THEN {v}" for n, v in dims.COVERAGE_FACTORS) + " ELSE 0 END"


def has_any(e: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), {lit(t)})" for t in terms) + ")"


def source_type(e: str) -> str:
    return f"({strings(ad.SOURCE_TYPES)})[1 + CAST(({e}) % 8 AS INT)]"


DOCS = f"""docs AS (
  SELECT doc_id, lang, {source_type("CAST(substr(source, 4) AS INT)")} AS source_type,
    source AS source_name,
    CASE WHEN doc_id % 3 <> 0 THEN 'https://corpus.example/' || source || '/' || doc_id END AS source_url,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS acquired_at,
    CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '{ad.AS_OF}' - ((doc_id * 37) % 3650) * INTERVAL 1 DAY
      END AS published_at,
    text || CASE WHEN doc_id % 10 = 0 THEN ' IGF-1' ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN '\nCopyright 2023 Example\nSubscribe to our newsletter now'
         ELSE '' END AS raw_content
  FROM documents)"""

IDED = f"""ided AS (
  SELECT *, {document_id(sha('raw_content'))} AS document_id, {tier()} AS evidence_tier FROM docs)"""

_STRIDE = dims.WINDOW_TOKENS - dims.WINDOW_OVERLAP
_BY_PARA = f"source_type IN {in_list(dims.PARAGRAPH_TYPES)}"
CLEANED = f"""cleaned AS (
  SELECT *, CASE WHEN source_type IN {in_list(dims.BOILERPLATE_TYPES)}
    THEN {norm(boiler('raw_content'))} ELSE {norm('raw_content')} END AS clean FROM ided),
parted AS (
  SELECT *, CASE WHEN {_BY_PARA} THEN {paras('clean')} ELSE {words('clean')} END AS parts FROM cleaned),
counted AS (
  SELECT *, CASE WHEN len(parts) = 0 THEN 0
    WHEN {_BY_PARA} THEN CAST(ceil(len(parts) / 4.0) AS BIGINT)
    ELSE greatest(1, CAST(ceil((len(parts) - 50) / {_STRIDE}.0) AS BIGINT)) END AS n_chunks FROM parted)"""

CHUNKS = f"""numbered AS (
  SELECT *, unnest(range(0, n_chunks)) AS chunk_index FROM counted),
chunks AS (
  SELECT *, document_id || '_' || printf('%04d', chunk_index) AS chunk_id, {sha('content')} AS content_hash
  FROM (SELECT doc_id, lang, source_type, source_name, source_url, acquired_at, published_at,
    document_id, evidence_tier, chunk_index,
    CASE WHEN {_BY_PARA} THEN array_to_string(parts[chunk_index*4+1 : chunk_index*4+4], '\n\n')
      ELSE array_to_string(parts[chunk_index*{_STRIDE}+1 : chunk_index*{_STRIDE}+512], ' ') END AS content
    FROM numbered))"""

ALL_CHUNKS = ",\n".join([DOCS, IDED, CLEANED, CHUNKS])

FIRST = ",\n".join([DOCS, IDED, """firsts AS (
  SELECT doc_id, document_id, source_type, source_name, source_url, published_at, evidence_tier,
    document_id || '_0000' AS chunk_id FROM ided)"""])

VECTORS = """vecs AS (
  SELECT e.vec_id AS doc_id, coalesce(f.chunk_id, 'vector_' || e.vec_id) AS chunk_id, f.document_id,
    coalesce(f.source_type, 'unknown') AS source_type, f.source_name, f.source_url, f.published_at,
    coalesce(f.evidence_tier, 3) AS evidence_tier, e.label,
    list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vector
  FROM embeddings e LEFT JOIN firsts f ON e.vec_id = f.doc_id),
cells AS (
  SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding) AS v FROM embeddings),
label_queries AS (
  SELECT CAST(label AS VARCHAR) AS query_id, list(v ORDER BY pos) AS vector
  FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM cells GROUP BY label, pos) GROUP BY label)"""


def vector_hits(corpus: str, queries: str, k: int, ident: str = "chunk_id") -> str:
    return f"""scored AS (
  SELECT q.query_id, c.{ident} AS id, round(list_cosine_similarity(q.vector, c.vector), 9) AS similarity
  FROM {queries} q CROSS JOIN {corpus} c),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS retrieval_rank
  FROM scored QUALIFY retrieval_rank <= {k})"""


def bucket(w: str) -> str:
    h = f"md5(lower({w}))"
    digit = lambda i: f"(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    return f"(({digit(1)} % 4) * 16 + {digit(2)})"


def text_hits(queries: str, k: int) -> str:
    """Hash-embedding top-k of a (query_id, query) relation over the chunk table."""
    return f"""chunk_cells AS (
  SELECT chunk_id, b, count(*) AS n FROM (
    SELECT chunk_id, {bucket('w')} AS b FROM (
      SELECT chunk_id, unnest({words('content')}) AS w FROM chunks)) GROUP BY chunk_id, b),
query_cells AS (
  SELECT query_id, b, count(*) AS n FROM (
    SELECT query_id, {bucket('w')} AS b FROM (
      SELECT query_id, unnest({words('query')}) AS w FROM {queries})) GROUP BY query_id, b),
chunk_norms AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM chunk_cells GROUP BY chunk_id),
query_norms AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM query_cells GROUP BY query_id),
dots AS (
  SELECT query_id, chunk_id, sum(q.n * c.n) AS dot FROM query_cells q JOIN chunk_cells c USING (b)
  GROUP BY query_id, chunk_id),
scored AS (
  SELECT q.query_id, c.chunk_id AS id, round(COALESCE(d.dot, 0) / (q.norm * c.norm), 9) AS similarity
  FROM query_norms q CROSS JOIN chunk_norms c
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS retrieval_rank
  FROM scored QUALIFY retrieval_rank <= {k})"""


_DRUGS = strings(ad.MEDICATIONS)
REQUESTS = f"""requests AS (
  SELECT *, substr({sha('query')}, 1, 16) AS query_id FROM (
    SELECT c_custkey AS request_id, concat_ws(' ', ({strings(ad.REQUEST_TEXTS)})[1 + CAST(c_custkey % 5 AS INT)], b.text) AS query,
      ({strings(ad.ROLES)})[1 + CAST(c_custkey % 3 AS INT)] AS role, c_custkey % 2 = 0 AS restricted,
      c_custkey % 13 <> 0 AS has_case, c_mktsegment AS indication, c_custkey % 5 AS n_drugs,
      c_custkey % 3 = 0 AS no_labs,
      list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'pregnancy' END,
        CASE WHEN c_custkey % 11 = 0 THEN 'malignancy history' END,
        CASE WHEN c_custkey % 9 = 0 THEN 'Active malignancy' END,
        CASE WHEN c_custkey % 10 = 0 THEN 'pre-diabetes / T2DM uncontrolled' END],
        lambda x: x IS NOT NULL) AS contraindications
    FROM customer LEFT JOIN benchmark b ON b.item_id = c_custkey % ((SELECT max(item_id) FROM benchmark) + 1))),
queries AS (SELECT DISTINCT query_id, query FROM requests)"""

RANK_K = 8
RANKED = ",\n".join([ALL_CHUNKS, REQUESTS, text_hits("queries", RANK_K), f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS rank
  FROM (SELECT h.query_id, h.similarity, h.retrieval_rank, c.*, {score('h.similarity')} AS score
        FROM hits h JOIN chunks c ON c.chunk_id = h.id))"""])

_DISCLAIMER = dims.DISCLAIMER.format(product="this service")

AUDIT = f"""audit AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'chat_query' WHEN 'click' THEN 'upload'
      WHEN 'signup' THEN 'ingest_trigger' ELSE 'admin_action' END AS event_type,
    ts AS "timestamp", md5(CAST(event_id AS VARCHAR)) AS request_id,
    ({strings(ad.ROLES)})[1 + CAST(user_id % 3 AS INT)] AS role,
    CASE WHEN event_id % 50 = 0 THEN 'not json ' ELSE '' END || props AS data,
    CASE WHEN event_id % 40 = 0 THEN '' ELSE '10.0.' || (user_id // 250) || '.' || (user_id % 250) END AS ip,
    CAST(round(value * 100) AS INT) AS latency_ms, event_type = 'error' AS is_error
  FROM events)"""

JOBS = f"""jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, {source_type('o_custkey')} AS source_type,
    o_orderdate AS triggered_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running'
      ELSE CASE WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'completed' END END AS status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 <> 0 THEN CAST(trunc(o_totalprice) AS BIGINT)
      ELSE 0 END AS total_chunks,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 = 0 THEN 'source unreachable' END AS error
  FROM orders)"""

RESULTS = f"""results AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, {source_type('o_custkey')} AS source_type,
    o_orderkey % 17 = 0 AS failed,
    CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS n,
    (o_custkey % 100) / 4.0 AS seconds
  FROM orders)"""

TRIPLES = f"""raw_triples AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_linenumber % 3 AS turn,
    (l_orderkey + l_linenumber) % 2 = 1 AS swap,
    CASE WHEN p_brand = 'Brand#1' THEN 'BPC-157' ELSE p_brand END AS brand, n_name, p_type,
    ({strings([*dims.RELATIONS, 'RELATED_TO'])})[1 + CAST((l_orderkey + l_partkey) % 12 AS INT)] AS relation,
    CAST(l_orderkey % 5 + 1 AS INT) AS evidence_tier, round(l_discount * 10, 2) AS confidence
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey),
sided AS (
  SELECT *, CASE turn WHEN 0 THEN brand WHEN 1 THEN n_name ELSE p_type END AS a,
    CASE turn WHEN 0 THEN 'Peptide' WHEN 1 THEN 'Condition' ELSE 'Model' END AS a_kind,
    CASE turn WHEN 0 THEN n_name WHEN 1 THEN p_type ELSE brand END AS b,
    CASE turn WHEN 0 THEN 'Condition' WHEN 1 THEN 'Model' ELSE 'Peptide' END AS b_kind
  FROM raw_triples WHERE relation <> 'RELATED_TO'),
triples AS (
  SELECT CASE WHEN swap THEN b ELSE a END AS subject, CASE WHEN swap THEN b_kind ELSE a_kind END AS subject_type,
    CASE WHEN swap THEN a ELSE b END AS object, CASE WHEN swap THEN a_kind ELSE b_kind END AS object_type,
    relation, evidence_tier, confidence, CAST(l_partkey AS VARCHAR) AS source_chunk_id,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq
  FROM sided)"""
EDGES = TRIPLES + """,
edges AS (
  SELECT subject AS src, object AS dst, relation, evidence_tier, source_chunk_id, confidence FROM triples
  QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY seq DESC) = 1)"""


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
