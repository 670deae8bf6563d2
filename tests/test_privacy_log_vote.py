import random

from pyspark.sql import functions as F

from claimgrain.functions import text
from claimgrain.operators import audit, graph, privacy
from claimgrain.operators.ranking import hybrid_topk


def test_pii_scan(spark):
    rows = [("write to a.b+c@mail.example.com, now", 1, 0, 0, 0, "write to [email], now"),
            ("call +1 (663) 555-6869 or 663-555-6869.", 0, 2, 0, 0, "call [phone] or [phone]."),
            ("from 114.203.152.12 id 4304158793483661 and 123-45-6789", 0, 0, 1, 2,
             "from [address] id [number] and [number]"),
            ("x1234567890@host.org", 1, 0, 0, 0, "[email]"), ("in 2024, 12345678 items at 3.5", 0, 0, 0, 0, None),
            ("", 0, 0, 0, 0, None)]
    df = spark.createDataFrame([(r[0],) for r in rows] + [(None,)], "text string")
    got = {r.text: r for r in privacy.pii_scan(df).collect()}
    for value, *counts, redacted in rows:
        r = got[value]
        assert [r.n_email, r.n_phone, r.n_address, r.n_number] == counts
        assert r.redacted == (value if redacted is None else redacted)
    assert got[None].redacted is None and got[None].n_email == 0
    assert privacy.pii_scan(df).filter(privacy.holds_pii()).count() == 4


def test_log_append_is_repeatable(spark, tmp_path):
    rows = [("chat_query", "2024-01-01 10:00:00", None, "admin", "{}", "10.0.0.1"),
            ("chat_query", "2024-01-01 10:00:00", "", "admin", "{}", ""),
            ("upload", "2024-01-02 10:00:00.5", "r1", None, None, "10.0.0.1")]
    events = spark.createDataFrame(rows, "event_type string, timestamp string, request_id string, role string, data string, ip string")
    events = events.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    path = str(tmp_path / "log")
    audit.append_log(events, path, b"salt")
    audit.append_log(events.filter("event_type = 'upload'"), path, b"salt")  # a job run again
    audit.append_log(events.limit(1).withColumn("data", F.lit('{"n": 2}')), path, b"salt")
    log = audit.read_log(spark, path).collect()
    assert len(log) == 4 and len({r.event_id for r in log}) == 4
    assert all(r.request_id for r in log) and "10.0.0.1" not in str(log)
    assert audit.log_rows(events, b"salt").columns == audit.LOG_COLUMNS


def test_vote_language(spark):
    rows = {"The cat is on the mat and it was fine": "en", "Der Hund ist nicht auf dem Weg": "de",
            "le chat est dans la rue": "fr", "el perro y las casas del barrio": "es", "zzz": None, "": None,
            "thesis": None}
    df = spark.createDataFrame([(t,) for t in rows], "a string")
    assert {r.a: r.v for r in df.select("a", text.vote_language(F.col("a")).alias("v")).collect()} == rows
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = docs.filter(text.vote_language(F.col("text")) == F.col("lang")).count()
    assert right >= 0.95 * docs.count()


def test_hub_paths_meet_from_the_smaller_side(spark):
    """A hub with 3,000 out-edges and as many targets: rows follow the pairs."""
    n = 3000
    links = [("hub", f"m{i}") for i in range(n)] + [(f"m{i}", f"y{i}") for i in range(n)] + [
        (f"y{i}", f"t{i}") for i in range(n)]
    edges = spark.createDataFrame(links, "src string, dst string")
    pairs = spark.createDataFrame([("hub", f"t{i}") for i in range(n)], "source string, target string")
    heads = edges.filter("src <> 'hub'").select(F.lit("hub").alias("source"), F.col("src").alias("x"), F.col("dst").alias("y"))
    into = edges.select(F.col("src").alias("y"), F.col("dst").alias("target"))
    assert graph._meet(pairs, heads, into).count() == n
    got = graph.evidence_paths(edges, pairs)
    assert got.count() == n and got.filter("hops = 3").count() == n


def test_hybrid_equals_whole_pool(spark):
    rng = random.Random(7)
    triples = [(f"e{rng.choice([0, 0, rng.randrange(30)])}", f"e{rng.randrange(30)}", f"c{i}") for i in range(300)]
    edges = spark.createDataFrame(triples, "src string, dst string, source_chunk_id string")
    meta = spark.createDataFrame([(f"c{i}", f"c{i}", rng.randrange(1, 6), None) for i in range(300)],
                                 "id string, chunk_id string, evidence_tier int, published_at timestamp_ntz")
    hits = [(f"q{a}", f"c{i}", rng.random(), n + 1) for a in range(6) for n, i in enumerate(rng.sample(range(300), 4))]
    hit_rows = spark.createDataFrame(hits, "query_id string, id string, similarity double, retrieval_rank int")
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")
    got = hybrid_topk(hit_rows, edges, meta, as_of, k=5, hits_per_query=4)
    # the whole pool at once: a list long enough to hold every chunk
    want = hybrid_topk(hit_rows, edges, meta, as_of, k=400, hits_per_query=400).filter("rank <= 5")
    pick = lambda df: sorted((r.query_id, r["rank"], r.id, r.from_graph) for r in df.collect())
    assert pick(got) == pick(want)
    reached = graph.expand_hits(hit_rows.withColumnRenamed("id", "chunk_id"), edges).select(
        "query_id", F.col("chunk_id").alias("id")).union(hit_rows.select("query_id", "id")).distinct()
    full = hybrid_topk(hit_rows, edges, meta, as_of, k=400, hits_per_query=400)
    assert sorted(map(tuple, full.select("query_id", "id").collect())) == sorted(map(tuple, reached.collect()))
