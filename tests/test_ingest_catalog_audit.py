import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from claimgrain.operators import audit, catalog, ingest
from claimgrain.sources import adapters, files
from claimgrain.streaming import jobs

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
DOC = "source_type string, source_name string, source_url string, acquired_at timestamp_ntz, raw_content string"


def docs(spark, *rows):
    return spark.createDataFrame([(k, n, u, T0, r) for k, n, u, r in rows], DOC)


def test_pipeline_per_type(spark):
    long = " ".join(f"w{i}" for i in range(600))
    paras = "\n\n".join(f"p{i}" for i in range(6))
    got = ingest.ingest(docs(
        spark, ("document", "d", None, long + "\nCopyright 2020 X"), ("forum", "f", None, paras),
        ("pubmed", "p", "https://x/1", "Copyright 2020 stays"), ("document", "e", None, "Privacy policy"),
        ("website", "w", "https://x/2", None))).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_name, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"d": 2, "f": 2, "p": 1}
    assert by["f"][0].content == "p0\n\np1\n\np2\n\np3" and by["p"][0].content == "Copyright 2020 stays"
    assert [r.evidence_tier for r in by["f"]] == [4, 4] and by["p"][0].evidence_tier == 1
    assert by["d"][1].chunk_id == by["d"][0].document_id + "_0001"


def test_ids_are_stable_and_distinct(spark):
    rows = docs(spark, ("forum", "same", None, "a"), ("forum", "same", None, "b"))
    first = sorted(r.document_id for r in ingest.ingest(rows).collect())
    assert first == sorted(r.document_id for r in ingest.ingest(rows.repartition(3)).collect())
    assert len(set(first)) == 2


def test_exact_dedup_of_a_hot_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"),
        (F.lit(5) - F.col("id") % 2).cast("int").alias("tier"), F.col("id").cast("string").alias("chunk_id"))
    got = {r.content_hash: r for r in ingest.exact_dedup(rows, "content_hash", ["tier", "chunk_id"]).collect()}
    assert len(got) == 2001 and got["hot"].copies == 1000 and (got["hot"].tier, got["hot"].chunk_id) == (4, "1005")


def test_upsert_is_repeatable(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    changes = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "k string, v int, version int")
    once = ingest.upsert(base, changes, "k", "version")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 9)]
    assert sorted(map(tuple, ingest.upsert(once, changes, "k", "version").collect())) == sorted(map(tuple, once.collect()))


def test_register_sources(spark):
    registry = spark.createDataFrame([("u1",)], "url string")
    wanted = spark.createDataFrame([("u1", 1, "blog", None), ("u2", 2, "youtube", "x"), ("u2", 3, "blog", None),
                                    ("u3", 4, "tape", None)], "url string, seq int, source_type string, label string")
    got = {r.url: (r.verdict, r.list_file, r.requests) for r in ingest.register_sources(registry, wanted).collect()}
    assert got == {"u1": ("already registered", "websites/urls.txt", 1), "u2": ("added", "youtube/video_ids.txt", 2),
                   "u3": ("unsupported", "", 1)}


def test_run_summary(spark):
    df = spark.createDataFrame([("a", 3, [], 1.5), ("a", 2, ["x"], .5), ("b", 1, [], 1.0)],
                               "source_type string, count bigint, errors array<string>, duration_seconds double")
    got = {r.source_type: (r.total_chunks, r.errors, r.duration_seconds, r.status) for r in ingest.run_summary(df).collect()}
    assert got == {"a": (5, 1, 2.0, "error"), "b": (1, 0, 1.0, "ok"), "total": (6, 1, 3.0, "error")}


def test_pages_cover_the_whole_list(spark):
    chunks = adapters.chunks(spark, SF)
    total = catalog.count_sources(chunks).collect()[0].total
    seen = []
    for offset in range(0, total + 80, 80):
        seen += [r.document_id for r in catalog.list_sources(chunks, limit=80, offset=offset).collect()]
    assert len(seen) == len(set(seen)) == total


def test_delete_patch_lookup(spark):
    chunks = spark.createDataFrame([("d_0", "d", 2, "h"), ("d_1", "d", 2, "h"), ("e_0", "e", 3, "h")],
                                   "chunk_id string, document_id string, evidence_tier int, content_hash string")
    remaining, report = catalog.delete_sources(chunks, spark.createDataFrame([("d",), ("zz",)], "document_id string"))
    assert [r.chunk_id for r in remaining.collect()] == ["e_0"]
    assert sorted(map(tuple, report.collect())) == [("d", 2), ("zz", 0)]
    assert catalog.delete_chunks(chunks, spark.createDataFrame([("d_1",)], "chunk_id string")).count() == 2
    patched = catalog.patch_chunks(chunks, spark.createDataFrame(
        [("d_0", 5, None), ("d_1", None, "n"), ("e_0", 7, "bad tier")], "chunk_id string, tier_override int, notes string"))
    assert {r.chunk_id: (r.before, r.after, r.notes) for r in catalog.change_log(patched).collect()} == {
        "d_0": (2, 5, None), "d_1": (2, 2, "n")}
    found = catalog.lookup_chunks(chunks, spark.createDataFrame([("d_0",), ("nope",)], "chunk_id string"))
    assert {r.chunk_id: r.found for r in found.collect()} == {"d_0": True, "nope": False}


@pytest.mark.parametrize("where", [dict(), dict(role="admin"), dict(prefix="1"), dict(event_type="upload", prefix="%"),
                                   dict(since="2024-01-05 00:00:00", until="2024-01-06 12:00:00")])
def test_count_matches_rows(spark, where):
    events = adapters.audit_events(spark, SF)
    total = audit.count_events(events, **where).collect()[0].total
    assert total == events.filter(audit.event_condition(**where)).count()
    page = audit.search_events(events, limit=10_000, **where)
    assert page.count() == min(total, 500)


def test_job_states(spark):
    log = spark.createDataFrame(
        [("a", "x", 0, "queued", 0, None, None, T0), ("a", "x", 1, "running", 0, None, None, T0),
         ("a", "x", 2, "completed", 7, "{}", None, T0 + dt.timedelta(hours=1)),
         ("b", "y", 0, "queued", 0, None, None, T0 + dt.timedelta(hours=2))],
        "job_id string, source_type string, step int, status string, total_chunks int, results string, error string, updated_at timestamp_ntz")
    state = audit.job_state(log)
    got = {r.job_id: (r.status, r.completed_at, r.total_chunks) for r in state.collect()}
    assert got == {"a": ("completed", T0 + dt.timedelta(hours=1), 7), "b": ("queued", None, 0)}
    assert audit.pipeline_status(state).collect()[0].job_id == "b"
    assert audit.pipeline_status(state.filter("false")).collect()[0].status == "idle"
    assert audit.running_conflict(state).collect()[0].conflict is False
    assert audit.running_conflict(audit.job_state(log.filter("step < 2"))).collect()[0].conflict is True


def test_payload_and_export(spark, tmp_path):
    events = spark.createDataFrame([(1, "upload", T0, "r", "admin", '{"k": 5}', "h"), (2, "upload", T0, "r", "admin", "broken", "")],
                                   "event_id int, event_type string, timestamp timestamp_ntz, request_id string, role string, data string, ip_hash string")
    got = {r.event_id: (r.valid_json, r.k) for r in audit.decode_payload(events, "$.k", "int", "k").collect()}
    assert got == {1: (True, 5), 2: (False, None)}
    out = str(tmp_path / "csv")
    files.write_audit_csv(events, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.columns == ["event_id", "event_type", "timestamp", "request_id", "role", "data", "ip_hash"]
    assert {r.data for r in back.collect()} == {'{"k":5}', "broken"}


def test_stream_replays_to_one_copy(spark, tmp_path):
    docs_in = adapters.shape_docs(jobs.read_table_stream(spark, SF, "documents"))
    table, mark = str(tmp_path / "t"), str(tmp_path / "c")
    jobs.ingest_stream(docs_in, table, mark)
    jobs.ingest_stream(docs_in, table, mark)             # nothing new: no second copy
    jobs.ingest_stream(docs_in, table, str(tmp_path / "c2"))   # progress lost: everything again
    got = jobs.current_chunks(spark, table).select("chunk_id", "content_hash")
    want = adapters.chunks(spark, SF).select("chunk_id", "content_hash")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_alert_stream_equals_batch(spark, tmp_path):
    events = adapters.shape_events(jobs.read_table_stream(spark, SF, "events"))
    jobs.alert_stream(events, str(tmp_path / "t"), str(tmp_path / "c"))
    got = jobs.latest_alerts(spark, str(tmp_path / "t"))
    want = audit.window_alerts(adapters.audit_events(spark, SF))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_audit_retention_border(spark):
    df = spark.createDataFrame([(T0,), (T0 - dt.timedelta(seconds=1),)], "timestamp timestamp_ntz")
    assert audit.retained(df, F.lit(T0 + dt.timedelta(days=90)).cast("timestamp_ntz")).count() == 1


def test_downgrade(spark):
    df = spark.createDataFrame([(1, False, False, False), (1, True, False, False), (5, True, False, False),
                                (2, True, True, False), (1, False, False, True)],
                               "evidence_tier int, stale boolean, marketing boolean, retracted boolean")
    assert [r.new_tier for r in catalog.downgrade_tiers(df).collect()] == [1, 2, 5, 5, 5]


def test_latest_per_key(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", "w", 1)],
                                "k string, v string, version int")
    assert sorted(map(tuple, ingest.latest_per_key(log, "k", "version").collect())) == [("a", "y", 3), ("b", "w", 1)]


def test_later_patches_win_per_field(spark):
    chunks = spark.createDataFrame([("c", 3)], "chunk_id string, evidence_tier int")
    patches = spark.createDataFrame([("c", 1, "first", 1), ("c", None, "second", 2), ("c", 9, "third", 3)],
                                    "chunk_id string, tier_override int, notes string, seq int")
    rows = catalog.patch_chunks(chunks, patches).collect()
    assert [(r.evidence_tier, r.notes) for r in rows] == [(1, "second")]


def test_bucketed_upsert_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.range(500).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.lit("old").alias("v"))
    ingest.write_bucketed(base, path, "chunk_id", 64)
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    changes = spark.createDataFrame([("k7", "a", 1), ("k7", "b", 2), ("new", "c", 1)], "chunk_id string, v string, version int")
    assert 1 <= ingest.upsert_bucketed(spark, path, changes, "chunk_id", "version", 64) <= 2
    assert len(before.keys() - files().keys()) <= 2
    spark.catalog.refreshByPath(path)
    got = {r.chunk_id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {f"k{i}": "old" for i in range(500)} | {"k7": "b", "new": "c"}
    assert ingest.upsert_bucketed(spark, path, changes.limit(0), "chunk_id", "version", 64) == 0


def test_conditions_reach_the_documents_before_cleaning(spark):
    """The type condition stands below the Python step and in the scan."""
    chunks = adapters.chunks(spark, "/root/testdata/sf0.001", "pubmed", 1)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")
