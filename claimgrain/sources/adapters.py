"""Views of the benchmark tables in the shapes the operators expect.

Each adapter is a projection or join over whole tables; ``plans.sqltext`` holds the same
rules as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import ids, scoring
from claimgrain.operators import graph, ingest, knowledge

AS_OF = "2024-06-30 00:00:00"
RUN_AT = "2024-07-01 00:00:00"
SOURCE_TYPES = ["pubmed", "document", "website", "youtube", "skool_course", "skool_community",
                "forum", "anecdotal"]
ROLES = ["researcher", "clinician", "admin"]
REQUEST_TEXTS = [
    "What is the recommended dosing schedule for this therapy?",
    "Is BPC-157 safe to use during pregnancy?",
    "How does Selank influence anxiety in adults?",
    "Can CJC-1295 be given to a patient with a history of melanoma?",
    "Give an overview of current recovery protocols.",
]
MEDICATIONS = ["metformin", "warfarin", "insulin", "lisinopril"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.spread(table(spark, sf_dir, "documents"), "doc_id")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def as_of():
    return ntz(AS_OF)


def _pick(items: list[str], index):
    return F.get(F.array(*[F.lit(i) for i in items]), index.cast("int"))


def source_type(number):
    return _pick(SOURCE_TYPES, number % len(SOURCE_TYPES))


def docs_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_docs(documents(spark, sf_dir))


def shape_docs(documents: DataFrame) -> DataFrame:
    """documents with ingest metadata and the raw text."""
    doc = F.col("doc_id")
    url = F.concat(F.lit("https://corpus.example/"), F.col("source"), F.lit("/"), doc.cast("string"))
    raw = F.concat(
        F.col("text"), F.when(doc % 10 == 0, " IGF-1").otherwise(""),
        F.when(doc % 4 == 0, "\nCopyright 2023 Example\nSubscribe to our newsletter now")
        .otherwise(""))
    return documents.select(
        "doc_id", "lang",
        source_type(F.substring("source", 4, 10).cast("int")).alias("source_type"),
        F.col("source").alias("source_name"),
        F.when(doc % 3 != 0, url).alias("source_url"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE")
        .alias("acquired_at"),
        F.when(doc % 5 != 0, F.expr(
            f"timestamp_ntz'{AS_OF}' - ((doc_id * 37) % 3650) * INTERVAL '1' DAY"))
        .alias("published_at"),
        raw.alias("raw_content"))


def chunks(spark: SparkSession, sf_dir: str, source_type: str | None = None,
           tier: int | None = None) -> DataFrame:
    """The chunk table of all documents, or of those of one type and tier.

    Both follow from the source columns, so the condition is put to the documents: others are
    neither cleaned nor cut."""
    docs = docs_meta(spark, sf_dir)
    if source_type is not None:
        docs = docs.filter(F.col("source_type") == source_type)
    if tier is not None:
        docs = docs.filter(scoring.infer_tier(F.col("source_type"), F.col("source_name")) == tier)
    return ingest.ingest(docs)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table as JSON lines: a sixth lose optional fields, a tenth are cut short."""
    sparse = F.col("doc_id") % 6 == 0
    whole = chunks(spark, sf_dir).select(
        "doc_id", "chunk_id", "document_id",
        F.when(~sparse, F.col("source_type")).alias("source_type"), "source_name",
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.when(~sparse, ids.isoformat(F.col("acquired_at"))).alias("acquired_at"),
        ids.isoformat(F.col("published_at")).alias("published_at"),
        F.when(~sparse, F.col("evidence_tier")).alias("evidence_tier_default"),
        F.lit(None).cast("string").alias("jurisdiction"), "content_hash", "content", "chunk_index")
    lines = whole.select("doc_id", F.to_json(F.struct(
        *[c for c in whole.columns if c != "doc_id"])).alias("line"))
    return lines.select(F.when(F.col("doc_id") % 10 == 3, F.substring("line", 1, 30))
                        .otherwise(F.col("line")).alias("value"))


def first_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and ranking metadata of every document's first chunk, without cutting the text."""
    docs = ingest.with_document_ids(shape_docs(table(spark, sf_dir, "documents")))
    return docs.select(
        "doc_id", "document_id", "source_type", "source_name", "source_url", "published_at",
        ids.chunk_id(F.col("document_id"), F.lit(0)).alias("chunk_id"),
        scoring.source_type_tier(F.col("source_type")).alias("evidence_tier"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored vectors with the metadata of the first chunk of the document of their number;
    a vector without a document keeps a name of its own and the defaults."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label",
        F.col("embedding").cast("array<double>").alias("vector"))
    return vectors.join(first_chunk_ids(spark, sf_dir), "doc_id", "left").withColumns({
        "chunk_id": F.coalesce("chunk_id", F.concat(F.lit("vector_"), F.col("doc_id").cast("string"))),
        "source_type": F.coalesce("source_type", F.lit("unknown")),
        "evidence_tier": F.coalesce("evidence_tier", F.lit(3))})


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of all its vectors, averaged per position before the
    shuffle and reassembled from one row per position."""
    cells = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"])
        .alias("vector")).select(F.col("label").cast("string").alias("query_id"), "vector")


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", "url", "html")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as posts of threads."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"),
        F.col("role").alias("author"), F.col("text").alias("content"),
        F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("title"))


def _exported(spark: SparkSession, sf_dir: str, stem: str, body) -> DataFrame:
    """One JSON file per conversation; ``body`` makes it from the sorted turns."""
    rows = turns(spark, sf_dir).groupBy("thread_id", "title").agg(F.array_sort(F.collect_list(
        F.struct("position", "author", "content"))).alias("posts"))
    return rows.select(F.concat(F.lit(stem), F.col("thread_id").cast("string")).alias("stem"),
                       F.to_json(body).alias("value"))


def thread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as forum exports: one list of one thread per file."""
    posts = F.transform("posts", lambda p: F.struct(p["author"].alias("author"),
                                                    p["content"].alias("content")))
    return _exported(spark, sf_dir, "threads_", F.array(F.struct("title", posts.alias("posts"))))


def community_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as community exports, as one post each or as an object with ``posts``."""
    first = F.filter("posts", lambda p: p["position"] == 0)
    replies = F.transform(F.filter("posts", lambda p: p["position"] != 0), lambda p: F.struct(
        p["author"].alias("author"), p["content"].alias("content")))
    post = F.struct(F.get(first, F.lit(0))["content"].alias("content"), replies.alias("replies"))
    return _exported(spark, sf_dir, "posts_", F.struct(F.array(post).alias("posts")))


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as parsed abstracts: the first line is the title."""
    names = F.transform(F.sequence(F.lit(1), F.lit(8)),
                        lambda i: F.concat(F.lit("Author "), i.cast("string")))
    doc = F.col("doc_id")
    return (documents(spark, sf_dir).select(
        doc.cast("string").alias("pmid"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"),
        F.slice(names, 1, (doc % 8).cast("int")).alias("authors"),
        F.when(doc % 2 != 0, F.concat(F.lit("Journal "), (doc % 5).cast("string")))
        .alias("journal")))


def course_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as JSON course exports, one per document, with levels left out in turn."""
    title = F.concat(F.lit("Lesson "), F.col("doc_id").cast("string"))
    lesson = F.struct(title.alias("title"), F.col("text").alias("content"),
                      F.lit(None).cast("string").alias("text"))
    lesson_text = F.struct(F.lit(None).cast("string").alias("title"),
                           F.lit(None).cast("string").alias("content"), F.col("text").alias("text"))
    course = F.col("source").alias("course_name")
    full = F.to_json(F.struct(course, F.array(F.struct(
        F.array(lesson, lesson_text).alias("lessons"))).alias("modules")))
    no_modules = F.to_json(F.struct(course, F.array(lesson).alias("lessons")))
    no_lessons = F.to_json(F.array(F.struct(
        course, F.array(lesson).alias("modules"))))
    bare = F.to_json(F.struct(F.col("text").alias("content")))
    kind = F.col("doc_id") % 4
    return documents(spark, sf_dir).select(
        F.concat(F.lit("export_"), F.col("doc_id").cast("string")).alias("stem"),
        F.when(kind == 0, full).when(kind == 1, no_modules).when(kind == 2, no_lessons)
        .otherwise(bare).alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as request log with an optional patient case. Every query is one of the fixed
    sentences followed by a benchmark text."""
    key = F.col("c_custkey")
    contraindications = F.filter(F.array(
        F.when(key % 7 == 0, F.lit("pregnancy")),
        F.when(key % 11 == 0, F.lit("malignancy history")),
        F.when(key % 9 == 0, F.lit("Active malignancy")),
        F.when(key % 10 == 0, F.lit("pre-diabetes / T2DM uncontrolled"))),
        lambda c: c.isNotNull())
    labs = F.when(key % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("IGF-1"), F.lit("180 ng/mL")))
    case = F.struct(
        F.lit("40-49").alias("age_range"), F.array("c_mktsegment").alias("indications"),
        contraindications.alias("contraindications"),
        F.slice(F.array(*[F.lit(m) for m in MEDICATIONS]), 1, (key % 5).cast("int"))
        .alias("current_medications"),
        labs.alias("baseline_labs"), F.lit(None).cast("string").alias("notes"))
    sentence = _pick(REQUEST_TEXTS, key % len(REQUEST_TEXTS))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("topic"))
    last = items.agg(F.max("item_id")).first()[0]
    query = F.concat_ws(" ", sentence, "topic")
    return (table(spark, sf_dir, "customer")
            .withColumn("item_id", key % ((-1 if last is None else last) + 1))
            .join(items, "item_id", "left").select(
        key.alias("request_id"), query.alias("query"),
        ids.query_hash(query).alias("query_id"), _pick(ROLES, key % 3).alias("role"),
        (key % 2 == 0).alias("restricted"), F.when(key % 13 != 0, case).alias("case")))


def request_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asked for restricted guidance, without the texts that ``requests`` joins to them."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"), _pick(ROLES, key % 3).alias("role"), (key % 2 == 0).alias("restricted"))


def distinct_queries(requests: DataFrame) -> DataFrame:
    return requests.groupBy("query_id").agg(F.min("query").alias("query"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    """events as audit log."""
    kind = F.col("event_type")
    user = F.col("user_id")
    return events.select(
        "event_id",
        F.when(kind == "view", "chat_query").when(kind == "click", "upload")
        .when(kind == "signup", "ingest_trigger").otherwise("admin_action").alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.md5(F.col("event_id").cast("string").cast("binary")).alias("request_id"),
        _pick(ROLES, user % 3).alias("role"),
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("not json "), F.col("props")))
        .otherwise(F.col("props")).alias("data"),
        F.when(F.col("event_id") % 40 == 0, "").otherwise(
            F.concat_ws(".", F.lit("10.0"), (user / 250).cast("bigint").cast("string"),
                        (user % 250).cast("string"))).alias("ip"),
        F.round(F.col("value") * 100).cast("int").alias("latency_ms"),
        (kind == "error").alias("is_error"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as job log: a queued entry each, and a later one for started jobs."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    failed = key % 17 == 0
    later = F.when(status == "O", F.lit(None).cast("string")).when(status == "P", "running").when(
        failed, "failed").otherwise("completed")
    done = status == "F"
    entries = F.filter(F.array(
        F.struct(F.lit(0).alias("step"), F.lit("queued").alias("status"),
                 F.lit(0).cast("bigint").alias("total_chunks"),
                 F.lit(None).cast("string").alias("error"),
                 F.col("o_orderdate").alias("updated_at")),
        F.struct(F.lit(1).alias("step"), later.alias("status"),
                 F.when(done & ~failed, F.col("o_totalprice").cast("bigint")).otherwise(F.lit(0))
                 .alias("total_chunks"),
                 F.when(done & failed, "source unreachable").alias("error"),
                 (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"))),
        lambda e: e["status"].isNotNull())
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("job_id"), source_type(F.col("o_custkey")).alias("source_type"),
        F.inline(entries)).withColumn(
        "results", F.concat(F.lit('{"count": '), F.col("total_chunks").cast("string"), F.lit("}")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimgrain.operators.audit import job_state
    return job_state(job_log(spark, sf_dir))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as finished ingest runs."""
    failed = F.col("o_orderkey") % 17 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        source_type(F.col("o_custkey")).alias("source_type"),
        F.when(failed, F.lit(0)).otherwise(F.col("o_totalprice").cast("bigint")).cast("bigint")
        .alias("count"),
        F.when(failed, F.array(F.lit("source unreachable"), F.lit("retry failed"))).otherwise(
            F.array().cast("array<string>")).alias("errors"),
        ((F.col("o_custkey") % 100) / 4).alias("duration_seconds"))


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part and supplier as extracted triples between brands, nations and types.

    One relation index in twelve is outside the vocabulary; one brand is written as a
    padded synonym so that linking has work to do.
    """
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (item.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    brand = F.when(F.col("p_brand") == "Brand#1", " BPC157 ").otherwise(F.col("p_brand"))
    end = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"))
    peptide, condition, model = (end(brand, "Peptide"), end(F.col("n_name"), "Condition"),
                                 end(F.col("p_type"), "Model"))
    turn = F.col("l_linenumber") % 3
    left = F.when(turn == 0, peptide).when(turn == 1, condition).otherwise(model)
    right = F.when(turn == 0, condition).when(turn == 1, model).otherwise(peptide)
    swap = (F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 1
    relations = F.array(*[F.lit(r) for r in [*dims.RELATIONS, "RELATED_TO"]])
    return joined.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("seq"),
        F.when(swap, right).otherwise(left).alias("s"),
        F.when(swap, left).otherwise(right).alias("o"),
        F.get(relations, ((F.col("l_orderkey") + F.col("l_partkey")) % 12).cast("int"))
        .alias("relation"),
        (F.col("l_orderkey") % 5 + 1).cast("int").alias("evidence_tier"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.col("l_partkey").alias("doc_id")).select(
        "seq", F.col("s.name").alias("subject"), F.col("s.kind").alias("subject_type"),
        "relation", F.col("o.name").alias("object"), F.col("o.kind").alias("object_type"),
        "evidence_tier", "confidence", "doc_id")


def linked_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary-checked, linked triples; the supporting chunk is named by document number."""
    kept = raw_triples(spark, sf_dir).filter(F.col("relation").isin(dims.RELATIONS))
    return knowledge.link_entities(kept).withColumn(
        "source_chunk_id", F.col("doc_id").cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(linked_triples(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as model responses holding two claims, fenced in different ways: the whole
    text is one claim and the other's quote. A fourth of them is cut short."""
    claim = lambda text, quote, conf: F.struct(
        text.alias("claim_text"), F.array(F.lit("BPC-157")).alias("peptide_mentioned"),
        F.array("lang").alias("condition_mentioned"), F.lit("efficacy").alias("claim_type"),
        F.lit("may").alias("certainty_language"), F.lit(conf).alias("confidence"),
        quote.alias("supporting_quote"))
    text, source = F.col("text"), F.col("source")
    body = F.to_json(F.array(claim(text, source, 0.85), claim(source, text, 0.5)))
    kind = F.col("doc_id") % 4
    raw = (F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
           .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
           .when(kind == 2, body)
           .otherwise(F.expr("substring(b, 1, length(b) - 5)")))
    docs = documents(spark, sf_dir).withColumn("b", body)
    return docs.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("evidence_tier"), raw.alias("raw"))


def triple_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as model responses holding one triple, some as a single object, some unfenced."""
    body = _triple_json()
    raw = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(F.col("p_partkey") % 3 == 1, body)
           .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```"))))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), raw.alias("raw"))


def triple_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as stored triple files; every fifth is cut short."""
    body = _triple_json()
    cut = F.when(F.col("p_partkey") % 5 == 0, F.substring(body, 1, 20)).otherwise(body)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/triples/"), F.col("p_partkey").cast("string"), F.lit("_triples.json"))
        .alias("path"), cut.alias("value"))


def _triple_json():
    relation = F.get(F.array(*[F.lit(r) for r in [*dims.RELATIONS, "RELATED_TO"]]),
                     (F.col("p_partkey") % 12).cast("int"))
    triple = F.struct(
        F.col("p_brand").alias("subject"), F.lit("Peptide").alias("subject_type"),
        relation.alias("relation"), F.col("p_name").alias("object"),
        F.lit("Condition").alias("object_type"),
        (F.col("p_size") % 10 / 10).alias("confidence"))
    return F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array(triple))).otherwise(
        F.to_json(triple))
