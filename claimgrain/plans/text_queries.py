"""Cleaning, chunking, hashing and source-shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import chunking, ids, scoring, text
from claimgrain.operators import ingest, privacy
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.sources import adapters as ad
from claimgrain.sources import exports, files


@register("normalize_text", q.query(q.DOCS, f"SELECT doc_id, {q.norm('raw_content')} AS text FROM docs"))
def normalize_text(spark, sf):
    return ad.docs_meta(spark, sf).select(
        "doc_id", text.normalize_whitespace(F.col("raw_content")).alias("text"))


@register("remove_boilerplate", q.query(q.DOCS, f"""
SELECT doc_id, {q.norm(q.boiler('raw_content'))} AS text,
  length(raw_content) - length({q.boiler('raw_content')}) AS removed_chars FROM docs"""))
def remove_boilerplate(spark, sf):
    cut = ad.docs_meta(spark, sf).withColumn("cut", text.drop_boilerplate(F.col("raw_content")))
    return cut.select("doc_id", text.normalize_whitespace(F.col("cut")).alias("text"),
                      (F.length("raw_content") - F.length("cut")).cast("bigint")
                      .alias("removed_chars"))


@register("clean_html", f"SELECT page_id, {q.html('html')} AS text FROM pages")
def clean_html(spark, sf):
    return text.clean_html(ad.page_html(spark, sf), "html", "text").select("page_id", "text")


@register("detect_language", q.query(q.DOCS, """
SELECT doc_id, CASE WHEN length(raw_content) >= 20 THEN 'en' END AS detected FROM docs"""))
def detect_language(spark, sf):
    return ad.docs_meta(spark, sf).select(
        "doc_id", text.detect_language(F.col("raw_content")).alias("detected"))


# The vote written out: one row per word, joined with the frequent words of each language.
@register("language_accuracy", r"""
WITH stop(lang, w) AS (
  SELECT 'de', unnest(string_split('der die das und in zu den von mit ist im ein eine nicht auf des dem sich', ' '))
  UNION ALL SELECT 'en', unnest(string_split('the of and to in is that it was for are by with as on be at this', ' '))
  UNION ALL SELECT 'es', unnest(string_split('el la los las de y en que un una por con del se para es su al', ' '))
  UNION ALL SELECT 'fr', unnest(string_split('le la les de des et un une en que pour dans sur qui au du par est', ' '))),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
votes AS (SELECT doc_id, stop.lang, count(*) AS n FROM tokens JOIN stop USING (w) GROUP BY ALL),
best AS (SELECT doc_id, lang FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT d.lang, coalesce(b.lang, 'none') AS detected, count(*) AS documents
FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY ALL""")
def language_accuracy(spark, sf):
    """How often the stop-word vote finds the language the table names."""
    found = F.coalesce(text.vote_language(F.col("text")), F.lit("none"))
    return (ad.documents(spark, sf).groupBy("lang", found.alias("detected"))
            .agg(F.count(F.lit(1)).alias("documents")))


@register("pii_scan", """
WITH e AS (SELECT doc_id, text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}' AS p FROM documents),
f AS (SELECT doc_id, len(regexp_extract_all(text, p)) AS n_email, regexp_replace(text, p, '[email]', 'g') AS t,
  '([+][0-9]{1,3}[ .-]?)?([(][0-9]{3}[)] ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}' AS p FROM e),
g AS (SELECT doc_id, n_email, len(regexp_extract_all(t, p)) AS n_phone, regexp_replace(t, p, '[phone]', 'g') AS t,
  '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}' AS p FROM f),
h AS (SELECT doc_id, n_email, n_phone, len(regexp_extract_all(t, p)) AS n_address, regexp_replace(t, p, '[address]', 'g') AS t,
  '[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9,}' AS p FROM g)
SELECT doc_id, n_email, n_phone, n_address, len(regexp_extract_all(t, p)) AS n_number,
  regexp_replace(t, p, '[number]', 'g') AS redacted FROM h""")
def pii_scan(spark, sf):
    return privacy.pii_scan(ad.documents(spark, sf)).select(
        "doc_id", "n_email", "n_phone", "n_address", "n_number", "redacted")


@register("checked_pii")
def checked_pii(spark, sf):
    """Card, network and account numbers of whole documents whose digits hold."""
    return privacy.checked_pii(ad.documents(spark, sf)).select("doc_id", "n_card", "n_ipv4", "n_account", "masked")


@register("chunk_tokens", """
WITH w AS (SELECT doc_id, %s AS words FROM documents),
n AS (SELECT *, CASE WHEN len(words) = 0 THEN 0
  ELSE greatest(1, CAST(ceil((len(words) - 50) / 462.0) AS BIGINT)) END AS n FROM w),
c AS (SELECT *, unnest(range(0, n)) AS chunk_index FROM n)
SELECT doc_id, chunk_index, array_to_string(words[chunk_index*462+1 : chunk_index*462+512], ' ') AS content
FROM c""" % q.words("text"))
def chunk_tokens(spark, sf):
    split = ad.documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("w"))
    return split.select("doc_id", F.posexplode(chunking.token_windows(F.col("w")))
                        .alias("i", "content")).select(
        "doc_id", F.col("i").cast("bigint").alias("chunk_index"), "content")


@register("chunk_paragraphs", """
WITH p AS (SELECT doc_id, %s AS paras FROM documents),
c AS (SELECT *, unnest(range(0, CAST(ceil(len(paras) / 3.0) AS BIGINT))) AS chunk_index FROM p)
SELECT doc_id, chunk_index, array_to_string(paras[chunk_index*3+1 : chunk_index*3+3], '\n\n') AS content
FROM c""" % q.paras("replace(text, '\n', '\n\n')"))
def chunk_paragraphs(spark, sf):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    split = ad.documents(spark, sf).select(
        "doc_id", chunking.paragraphs(doubled).alias("p"))
    return split.select("doc_id", F.posexplode(chunking.paragraph_groups(F.col("p"), 3))
                        .alias("i", "content")).select(
        "doc_id", F.col("i").cast("bigint").alias("chunk_index"), "content")


# The oracle has no look-behind: the marks that do not end a sentence are hidden first.
@register("chunk_sentences", r"""
WITH hidden AS (
  SELECT doc_id, regexp_replace(text, '((?:\b(?:Dr|Mr|Mrs|Ms|Prof|St|vs|etc|Fig|al)|[A-Z][a-z]))([.!?])', '\1' || chr(1) || '\2', 'g') AS t
  FROM documents),
s AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, %s),
    lambda x: %s), lambda x: x <> '') AS parts
  FROM (SELECT doc_id, regexp_replace(t, '([^' || chr(1) || '])([.!?]+)(%s+)', '\1' || chr(2), 'g') AS t FROM hidden)),
c AS (SELECT *, unnest(range(0, CAST(ceil(len(parts) / 8.0) AS BIGINT))) AS chunk_index FROM s)
SELECT doc_id, chunk_index, array_to_string(parts[chunk_index*8+1 : chunk_index*8+8], ' ') AS content FROM c
""" % ("chr(2)", q.strip("replace(x, chr(1), '')"), q.text.BLANK))
def chunk_sentences(spark, sf):
    split = ad.documents(spark, sf).select(
        "doc_id", chunking.sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.posexplode(chunking.sentence_groups(F.col("s")))
                        .alias("i", "content")).select(
        "doc_id", F.col("i").cast("bigint").alias("chunk_index"), "content")


@register("content_hash", f"SELECT doc_id, {q.sha('text')} AS content_hash FROM documents")
def content_hash(spark, sf):
    return ad.table(spark, sf, "documents").select(
        "doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@register("document_ids", q.query(q.DOCS, f"SELECT doc_id, {q.document_id()} AS document_id FROM docs"))
def document_ids(spark, sf):
    return ad.docs_meta(spark, sf).select("doc_id", ids.document_id(
        F.col("source_url"), F.col("acquired_at"), F.col("source_name")).alias("document_id"))


@register("infer_tier", q.query(q.DOCS, f"""
SELECT doc_id, source_type, {q.tier()} AS tier,
  {q.case_of("lower(upper(source_type))", dims.SOURCE_TYPE_TIERS, "3")} AS type_tier,
  {q.tier("source_type", "source_name || ' via NCBI'")} AS named_tier FROM docs"""))
def infer_tier(spark, sf):
    kind, name = F.col("source_type"), F.col("source_name")
    return ad.docs_meta(spark, sf).select(
        "doc_id", "source_type", scoring.infer_tier(kind, name).alias("tier"),
        scoring.source_type_tier(F.upper(kind)).alias("type_tier"),
        scoring.infer_tier(kind, F.concat(name, F.lit(" via NCBI"))).alias("named_tier"))


@register("enrich_metadata", q.query(q.DOCS, f"""
SELECT source_type, source_name, source_url, {q.iso('acquired_at')} AS acquired_at,
  {q.iso('published_at')} AS published_at, {q.tier()} AS evidence_tier_default,
  {q.sha('raw_content')} AS content_hash, {q.document_id()} AS document_id FROM docs"""))
def enrich_metadata(spark, sf):
    return ingest.enrich_metadata(ad.docs_meta(spark, sf))


# ---- source shapes --------------------------------------------------------------------------

@register("document_files", f"""
WITH f AS (SELECT doc_id, text, (['txt', 'MD', 'pdf', 'docx'])[1 + CAST(doc_id % 4 AS INT)] AS ext,
  CASE WHEN doc_id % 9 = 0 THEN '.hidden' ELSE 'file.v' END AS prefix FROM documents)
SELECT prefix || doc_id AS source_name, '/landing/' || prefix || doc_id || '.' || ext AS file_path,
  text AS raw_content
FROM f WHERE ext IN ('txt', 'MD') AND prefix <> '.hidden' AND {q.strip('text')} <> ''""")
def document_files(spark, sf):
    doc = F.col("doc_id")
    name = F.concat(F.when(doc % 9 == 0, ".hidden").otherwise("file.v"), doc.cast("string"),
                    F.lit("."), F.get(F.array(*map(F.lit, ["txt", "MD", "pdf", "docx"])),
                                      (doc % 4).cast("int")))
    listing = ad.documents(spark, sf).select(
        F.concat(F.lit("/landing/"), name).alias("path"), F.col("text").alias("value"))
    return files.document_files(listing).select("source_name", "file_path", "raw_content")


@register("id_list", """
SELECT page_id, url AS value, CASE WHEN page_id % 3 = 0 THEN 'label ' || page_id END AS label
FROM pages WHERE page_id % 7 <> 0""")
def id_list(spark, sf):
    page = F.col("page_id")
    line = F.concat(F.when(page % 7 == 0, "  # ").otherwise(" "),
                    ingest.source_line(F.col("url"), F.when(
                        page % 3 == 0, F.concat(F.lit("label "), page.cast("string")))))
    return files.id_list(ad.table(spark, sf, "pages").select("page_id", line.alias("value")))


@register("forum_threads", f"""
SELECT conv_id AS thread_id, {q.norm("""'Thread: Thread ' || conv_id || chr(10) || chr(10)
  || string_agg(CASE WHEN text <> '' THEN '[' || role || ']: ' || text END, chr(10) || chr(10) ORDER BY turn)""")} AS content
FROM conversations GROUP BY conv_id""")
def forum_threads(spark, sf):
    return exports.thread_documents(ad.turns(spark, sf))


@register("community_posts", f"""
SELECT conv_id AS thread_id, {q.norm("""string_agg(
  CASE WHEN text = '' THEN NULL WHEN turn = 0 THEN text ELSE '[Reply from ' || role || ']: ' || text END,
  chr(10) || chr(10) ORDER BY turn)""")} AS content
FROM conversations GROUP BY conv_id""")
def community_posts(spark, sf):
    return exports.community_documents(ad.turns(spark, sf))


@register("transcripts", f"""
SELECT conv_id AS thread_id, {q.norm("string_agg(text, ' ' ORDER BY turn)")} AS content,
  'YouTube:' || conv_id AS source_name, {q.lit(dims.VIDEO_URL)} || conv_id AS source_url
FROM conversations GROUP BY conv_id""")
def transcripts(spark, sf):
    return exports.transcript_documents(ad.turns(spark, sf))


@register("thread_chunks", f"""
WITH t AS (SELECT conv_id, {q.norm("""'Thread: Thread ' || conv_id || chr(10) || chr(10)
  || string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn)""")} AS content
  FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, {q.paras('content')} AS paras FROM t),
c AS (SELECT *, unnest(range(0, CAST(ceil(len(paras) / 4.0) AS BIGINT))) AS chunk_index FROM p)
SELECT conv_id AS thread_id, chunk_index,
  array_to_string(paras[chunk_index*4+1 : chunk_index*4+4], '\n\n') AS content FROM c""")
def thread_chunks(spark, sf):
    return exports.thread_chunks(ad.turns(spark, sf))


@register("transcript_chunks", f"""
WITH t AS (SELECT conv_id, {q.norm("string_agg(text, ' ' ORDER BY turn)")} AS content
  FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, {q.words('content')} AS words FROM t),
c AS (SELECT *, unnest(range(0, CASE WHEN len(words) = 0 THEN 0
  ELSE greatest(1, CAST(ceil((len(words) - 12) / 28.0) AS BIGINT)) END)) AS chunk_index FROM w)
SELECT conv_id AS thread_id, chunk_index,
  array_to_string(words[chunk_index*28+1 : chunk_index*28+40], ' ') AS content FROM c""")
def transcript_chunks(spark, sf):
    """Windows of 40 words, so that most of them span several segments."""
    return exports.transcript_chunks(ad.turns(spark, sf), size=40, overlap=12)


@register("abstract_format", f"""
WITH a AS (
  SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract
  FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS pmid, 'PubMed:' || doc_id AS source_name,
  {q.lit(dims.ABSTRACT_URL)} || doc_id || '/' AS source_url, {q.norm("""'Title: ' || title || chr(10) || chr(10) || 'Abstract: ' || abstract
  || CASE WHEN doc_id % 8 > 0 THEN chr(10) || chr(10) || 'Authors: ' || array_to_string(
       list_transform(range(1, least(5, doc_id % 8) + 1), lambda i: 'Author ' || i), ', ') ELSE '' END
  || CASE WHEN doc_id % 2 <> 0 THEN chr(10) || 'Journal: Journal ' || (doc_id % 5) ELSE '' END""")} AS content
FROM a WHERE title <> '' OR abstract <> ''""")
def abstract_format(spark, sf):
    return exports.abstract_documents(ad.abstracts(spark, sf)).select(
        "pmid", "source_name", "source_url", "content")


_POSTS = """WITH t AS (SELECT conv_id, {own} AS content FROM conversations GROUP BY conv_id)
SELECT {name} || conv_id AS source_name, {place} AS position, {norm} AS content FROM t"""


@register("thread_files", _POSTS.format(name="'threads_'", place="0", norm=q.norm("content"), own="""
  'Thread: Thread ' || conv_id || chr(10) || chr(10) || string_agg(CASE WHEN text <> ''
    THEN '[' || role || ']: ' || text END, chr(10) || chr(10) ORDER BY turn)"""))
def thread_files(spark, sf):
    """conversations as exported thread files."""
    return exports.thread_export(ad.thread_files(spark, sf))


@register("community_files", _POSTS.format(name="'Skool Community: posts_'", place="0", norm=q.norm("content"), own="""
  string_agg(CASE WHEN text = '' THEN NULL WHEN turn = 0 THEN text ELSE '[Reply from ' || role || ']: ' || text END,
    chr(10) || chr(10) ORDER BY turn)"""))
def community_files(spark, sf):
    """conversations as exported community files: the first turn is the post."""
    return exports.community_export(ad.community_files(spark, sf))


@register("course_lessons", f"""
WITH d AS (SELECT *, doc_id % 4 AS kind, {q.norm('text')} AS content FROM documents WHERE text <> '')
SELECT 'export_' || doc_id AS stem, lesson_pos,
  CASE WHEN kind = 3 THEN 'export_' || doc_id || ': Lesson'
    ELSE source || ': Lesson' || CASE WHEN lesson_pos = 0 THEN ' ' || doc_id ELSE '' END END AS source_name,
  content
FROM (SELECT *, unnest(CASE WHEN kind = 0 THEN [0, 1] ELSE [0] END) AS lesson_pos FROM d)""")
def course_lessons(spark, sf):
    return exports.course_lessons(ad.course_exports(spark, sf)).select(
        "stem", "lesson_pos", "source_name", "content")


@register("course_lessons_nested", f"""
WITH d AS (SELECT *, doc_id % 4 AS kind, {q.norm('text')} AS content FROM documents WHERE text <> '')
SELECT 'export_' || doc_id AS stem,
  CASE kind WHEN 0 THEN '0.0.0.0.0.0.' || lesson_pos WHEN 3 THEN '0' ELSE '0.0' END AS position,
  CASE WHEN kind = 3 THEN 'export_' || doc_id || ': Lesson'
    ELSE source || ': Lesson' || CASE WHEN lesson_pos = 0 THEN ' ' || doc_id ELSE '' END END AS source_name,
  content
FROM (SELECT *, unnest(CASE WHEN kind = 0 THEN [0, 1] ELSE [0] END) AS lesson_pos FROM d)""")
def course_lessons_nested(spark, sf):
    """Course exports of which a fourth lie four levels deeper than the others."""
    files = ad.course_exports(spark, sf)
    deep = F.concat(F.lit('{"modules":[{"title":"m","sections":[{"units":[{"children":['), "value", F.lit("]}]}]}]}"))
    full = F.substring_index("stem", "_", -1).cast("bigint") % 4 == 0
    return exports.nested_lessons(files.withColumn("value", F.when(full, deep).otherwise(F.col("value"))))


@register("web_ingest", f"""
WITH d AS (SELECT page_id, url, {q.html('html')} AS raw FROM pages),
c AS (SELECT page_id, url, {q.norm(q.boiler('raw'))} AS clean FROM d WHERE raw <> ''),
w AS (SELECT *, {q.words('clean')} AS words, {q.uuid5(q.uuid.NAMESPACE_URL, 'url')} AS document_id FROM c),
n AS (SELECT *, unnest(range(0, CASE WHEN len(words) = 0 THEN 0
  ELSE greatest(1, CAST(ceil((len(words) - 50) / 462.0) AS BIGINT)) END)) AS i FROM w)
SELECT page_id, split_part(url, '/', 3) AS source_name, 3 AS evidence_tier, i AS chunk_index,
  document_id || '_' || printf('%04d', i) AS chunk_id,
  array_to_string(words[i*462+1 : i*462+512], ' ') AS content FROM n""")
def web_ingest(spark, sf):
    docs = exports.web_documents(ad.page_html(spark, sf)).withColumn(
        "acquired_at", ad.ntz(ad.RUN_AT))
    return ingest.ingest(docs).select("page_id", "source_name", "evidence_tier",
                                      F.col("chunk_index").cast("bigint").alias("chunk_index"),
                                      "chunk_id", "content")


@register("course_pages", f"""
WITH t AS (SELECT 'page_' || page_id AS source_name, {q.norm(q.html('html'))} AS content FROM pages)
SELECT * FROM t WHERE content <> ''""")
def course_pages(spark, sf):
    return exports.course_pages(ad.page_html(spark, sf).select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("stem"),
        F.col("html").alias("value")))


@register("chunk_export", q.query(q.ALL_CHUNKS, f"""
SELECT chunk_id, source_type, source_type AS meta_type, evidence_tier,
  {q.iso('acquired_at')} AS acquired_at, content_hash, chunk_index, content, true AS same_id
FROM chunks"""))
def chunk_export(spark, sf):
    """Chunks as JSON documents, read back field by field."""
    chunks = ad.chunks(spark, sf).withColumn("jurisdiction", F.lit(None).cast("string"))
    lines = files.chunk_json(chunks.withColumnRenamed("evidence_tier", "evidence_tier_default"))
    parsed = F.from_json("value", f"{files.CHUNK_SCHEMA}, metadata struct<source_type:string,chunk_id:string>")
    return lines.select(parsed.alias("c")).select(
        "c.chunk_id", "c.source_type", F.col("c.metadata.source_type").alias("meta_type"),
        F.col("c.evidence_tier_default").alias("evidence_tier"), "c.acquired_at", "c.content_hash",
        F.col("c.chunk_index").cast("bigint").alias("chunk_index"), "c.content",
        (F.col("c.metadata.chunk_id") == F.col("c.chunk_id")).alias("same_id"))


@register("load_chunks", q.query(q.ALL_CHUNKS, """
SELECT chunk_id, document_id, CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE source_type END AS source_type,
  source_url, CASE WHEN doc_id % 6 = 0 THEN 3 ELSE evidence_tier END AS evidence_tier,
  strftime(CASE WHEN doc_id % 6 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE acquired_at END,
    '%Y-%m-%d %H:%M:%S') AS acquired_at, content, chunk_index
FROM chunks WHERE doc_id % 10 <> 3"""))
def load_chunks(spark, sf):
    return files.load_chunks(ad.chunk_lines(spark, sf)).select(
        "chunk_id", "document_id", "source_type", "source_url", "evidence_tier",
        F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"), "content",
        F.col("chunk_index").cast("bigint").alias("chunk_index"))


@register("reindex", q.query(q.ALL_CHUNKS, f"""
SELECT chunk_id, array_to_string(list_transform(range(0, 64),
  lambda b: len(list_filter(bs, lambda x: x = b))), ',') AS counts
FROM (SELECT chunk_id, list_transform({q.words('content')}, lambda w: {q.bucket('w')}) AS bs
  FROM chunks WHERE doc_id % 10 <> 3)
UNION ALL SELECT document_id || '_0000', '-1' FROM ided WHERE doc_id % 10 = 3"""))
def reindex(spark, sf):
    """Loaded chunks embedded over a store of first chunks; unreadable ones keep their row."""
    store = ad.first_chunk_ids(spark, sf).select("chunk_id", F.array(F.lit(-1.0)).alias("vector"))
    return ingest.reindex(files.load_chunks(ad.chunk_lines(spark, sf)), store).select(
        "chunk_id", F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",")
        .alias("counts"))


@register("landing_validation", """
WITH f AS (SELECT doc_id, n_chars * 2000 AS size_bytes,
  (['pdf', 'TXT', 'md', 'exe', ''])[1 + CAST(doc_id % 5 AS INT)] AS ext FROM documents)
SELECT '/landing/file' || doc_id || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS path, size_bytes,
  ext IN ('pdf', 'TXT', 'md') AND size_bytes <= 52428800 AS accepted,
  CASE WHEN ext = 'exe' THEN 'Unsupported extension ''.exe''' WHEN ext = '' THEN 'Unsupported extension '''''
    WHEN size_bytes > 52428800 THEN 'File exceeds 50 MB limit' END AS reason FROM f""")
def landing_validation(spark, sf):
    doc = F.col("doc_id")
    suffix = F.get(F.array(*map(F.lit, [".pdf", ".TXT", ".md", ".exe", ""])), (doc % 5).cast("int"))
    listing = ad.table(spark, sf, "documents").select(
        F.concat(F.lit("/landing/file"), doc.cast("string"), suffix).alias("path"),
        (F.col("n_chars") * 2000).alias("size_bytes"))
    return files.validate_landing(listing).select("path", "size_bytes", "accepted", "reason")
