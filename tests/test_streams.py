"""Streams over files and folder tables, late rows, streamed deduplication, merged alerts."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgrain.operators import audit, ingest
from claimgrain.plans import registry
from claimgrain.sources import adapters
from claimgrain.streaming import jobs

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
EVENT = "timestamp timestamp_ntz, latency_ms int, is_error boolean"
DOC = ("source_type string, source_name string, source_url string, acquired_at timestamp_ntz, "
       "published_at timestamp_ntz, raw_content string")

registry.load_all()


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture
def folder_tables(spark, tmp_path):
    """The tables as Spark writes them: folders of four part files."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_alerts", "stream_distinct"])
def test_streams_over_folder_tables(spark, folder_tables, name):
    assert rows(registry.QUERIES[name](spark, folder_tables)) == rows(registry.QUERIES[name](spark, SF))


def test_one_file_per_trigger(spark, folder_tables, tmp_path):
    stream = jobs.read_table_stream(spark, folder_tables, "documents", max_files=1)
    jobs.ingest_stream(adapters.shape_docs(stream), str(tmp_path / "t"), str(tmp_path / "c"))
    got = jobs.current_chunks(spark, str(tmp_path / "t"))
    assert rows(got.select("chunk_id", "content_hash")) == rows(adapters.chunks(spark, SF).select("chunk_id", "content_hash"))
    assert len(list((tmp_path / "t").glob("batch=*"))) == 5  # the empty one and four triggers


@pytest.fixture
def backlog(spark, tmp_path):
    """Two days of events in six files, each with rows of any time; one hour holds a third, some
    rows lack time, latency or flag."""
    rng = random.Random(3)
    data = [(T0 + dt.timedelta(minutes=rng.randrange(2880)), rng.choice([5, 80, 7000, rng.randrange(9000)]),
             rng.random() < .02) for _ in range(1200)]
    data += [(T0 + dt.timedelta(hours=7), 120, False)] * 600
    data += [(None, 5, True)] * 7 + [(T0, None, None), (T0 + dt.timedelta(days=3), None, None)]
    rng.shuffle(data)
    for i in range(6):
        spark.createDataFrame(data[i::6], EVENT).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "late.parquet"))
    return str(tmp_path), spark.createDataFrame(data, EVENT)


def test_unordered_backlog_loses_nothing(spark, backlog, tmp_path):
    folder, events = backlog
    table = str(tmp_path / "alerts")
    jobs.alert_stream(jobs.read_table_stream(spark, folder, "late", max_files=1), table, str(tmp_path / "mark"))
    want = rows(audit.window_alerts(events))
    assert rows(jobs.latest_alerts(spark, table)) == want
    assert jobs.untimed(spark, table).first().events == 7
    assert jobs.alert_counts(spark, table).agg(F.sum("events")).first()[0] == events.count()
    last = jobs.compact_alerts(spark, table)
    assert last == 5 and rows(jobs.latest_alerts(spark, table)) == want
    assert jobs.compact_alerts(spark, table) == last
    # a second backlog: it joins windows that were merged before
    more = events.limit(100).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    more.coalesce(1).write.mode("append").parquet(f"{folder}/late.parquet")
    jobs.alert_stream(jobs.read_table_stream(spark, folder, "late", max_files=1), table, str(tmp_path / "mark"))
    assert rows(jobs.latest_alerts(spark, table)) == rows(audit.window_alerts(events.unionByName(more)))
    assert jobs.compact_alerts(spark, table) == 6
    assert rows(jobs.latest_alerts(spark, table)) == rows(audit.window_alerts(events.unionByName(more)))
    assert not list((tmp_path / "alerts").glob("run=3")) and list((tmp_path / "alerts").glob("run=6"))


def test_alert_stream_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(str(tmp_path / "none.parquet"))
    jobs.alert_stream(jobs.read_table_stream(spark, str(tmp_path), "none"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert jobs.latest_alerts(spark, str(tmp_path / "t")).collect() == []
    assert jobs.untimed(spark, str(tmp_path / "t")).first().events == 0


def document(name, minute, text, kind="document"):
    return (kind, name, None, T0 + dt.timedelta(minutes=minute), None, text)


def batch_distinct(docs):
    """First document per (type, text) and its chunks, by plain Python over the batch chunks."""
    ided = ingest.with_document_ids(docs).collect()
    owner, holders = {}, {}
    for r in ided:
        key = (r.source_type, r.raw_content or "")
        holders.setdefault(key, set()).add(r.document_id)
        owner[key] = min(owner.get(key, (r.acquired_at, r.document_id)), (r.acquired_at, r.document_id))
    own = {v[1]: len(holders[k]) for k, v in owner.items()}
    chunks = ingest.ingest(docs.dropDuplicates()).select("chunk_id", "document_id", "content_hash").distinct().collect()
    return sorted((r.chunk_id, r.content_hash, own[r.document_id]) for r in chunks if r.document_id in own)


@pytest.mark.parametrize("keep", ["7 days", "1 millisecond"])
def test_a_text_of_many_triggers_is_stored_once(spark, tmp_path, keep):
    batches = [
        [document("b", 5, "shared text"), document("x", 9, "only here")],
        [document("a", 2, "shared text"), document("b", 5, "shared text"), document("n", 1, None)],
        [document("c", 8, "shared text")] * 40 + [document("f", 3, "shared text", "forum"), document("n2", 4, "")],
        [document("b", 5, "shared text"), document("y", 6, "long " * 1200)],
    ]
    source = str(tmp_path / "docs.parquet")
    for batch in batches:
        spark.createDataFrame(batch, DOC).coalesce(1).write.mode("append").parquet(source)
    table = str(tmp_path / "t")
    stream = jobs.read_table_stream(spark, str(tmp_path), "docs", max_files=1)
    query = jobs.distinct_stream(stream, table, str(tmp_path / "c"), keep)
    got = jobs.distinct_chunks(spark, table)
    assert sorted((r.chunk_id, r.content_hash, r.copies) for r in got.collect()) == batch_distinct(spark.read.parquet(source))
    assert {r.copies for r in got.filter("content = 'shared text' AND source_type = 'document'").collect()} == {3}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    keys = len({(r.source_type, r.raw_content or "") for r in spark.read.parquet(source).collect()})
    if keep == "7 days":
        assert states[-1] == keys and spark.read.parquet(f"{table}/chunks").filter("content = 'shared text'").count() == 2
    else:  # forgotten keys leave the state; what is cut again is still read once
        assert max(states) < keys


def test_distinct_stream_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "none.parquet"))
    jobs.distinct_stream(jobs.read_table_stream(spark, str(tmp_path), "none"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert jobs.distinct_chunks(spark, str(tmp_path / "t")).collect() == []


# ---- sketches ---------------------------------------------------------------------------------

def test_sketch_ranks_are_within_the_bound(spark):
    rng = random.Random(9)
    data = [(T0 + dt.timedelta(minutes=rng.randrange(4 * 1440)), int(rng.lognormvariate(6, 1.5)), rng.random() < .01)
            for _ in range(30_000)]
    data += [(T0 + dt.timedelta(hours=30), rng.randrange(100_000), False) for _ in range(15_000)]  # a hot hour
    data += [(T0 + dt.timedelta(hours=30), 250, None)] * 5000 + [(None, 1, False), (T0 + dt.timedelta(days=9), None, True)]
    events = spark.createDataFrame(data, EVENT).repartition(8)
    hours = audit.hourly_sketches(events)
    bound = 2.296 / audit.SKETCH_K ** 0.9723
    for width, slide, hours_wide in (("1 hour", None, 1), ("1 day", None, 24), ("6 hours", "1 hour", 6)):
        got = audit.sketch_alerts(hours, width, slide).collect()
        groups = {}
        for t, latency, bad in data:
            if t is not None:
                hour = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
                starts = range(hour - 5, hour + 1) if slide else [hour // hours_wide * hours_wide]
                for s in starts:
                    groups.setdefault(s, []).append((latency, bad))
        assert len(got) == len(groups)
        for r in got:
            start = (dt.datetime.fromisoformat(r.window_start) - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
            own = groups[start]
            known = sorted(v for v, _ in own if v is not None)
            flags = [b for _, b in own if b is not None]
            assert r.events == len(own) and math.isclose(r.error_rate, sum(flags) / len(flags))
            if not known:
                assert r.p99_ms is None
                continue
            below, upto = (sum(v < r.p99_ms for v in known) / len(known), sum(v <= r.p99_ms for v in known) / len(known))
            assert r.p99_ms in known and below - bound <= 0.99 <= upto + bound + 1 / len(known)


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], EVENT)
    assert audit.sketch_alerts(audit.hourly_sketches(none)).collect() == []
    assert audit.partial_alerts(audit.alert_partials(none)).collect() == []


def test_latency_trend_over_the_whole_log(spark):
    got = registry.QUERIES["latency_trend"](spark, SF).collect()
    events = adapters.audit_events(spark, SF)
    total = events.count()
    assert sum(r.events for r in got if r.span == "day") == total
    assert sum(r.events for r in got if r.span == "6 hours") == 6 * total
    exact = {r.d: sorted(r.v) for r in events.groupBy(F.date_format("timestamp", "yyyy-MM-dd 00:00:00").alias("d"))
             .agg(F.collect_list("latency_ms").alias("v")).collect()}
    bound = 2.296 / audit.SKETCH_K ** 0.9723
    for r in got:
        if r.span == "day":
            v = exact[r.window_start]
            assert sum(x < r.p99_ms for x in v) / len(v) <= 0.99 + bound
            assert sum(x <= r.p99_ms for x in v) / len(v) >= 0.99 - bound - 1 / len(v)


# ---- equal events -----------------------------------------------------------------------------

LOG = "event_type string, timestamp timestamp_ntz, request_id string, role string, data string, ip string"


def test_equal_events_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "NUMBERED", 16)
    event = ("upload", T0, None, "admin", "{}", "10.0.0.1")
    other = ("upload", T0, "r1", "admin", None, "")
    first = spark.createDataFrame([event] * 3 + [other], LOG)
    path = str(tmp_path / "log")
    for _ in range(2):  # the second time is a retry
        audit.append_log(first, path, b"salt", batch="monday")
    assert audit.read_log(spark, path).count() == 4
    audit.append_log(first.orderBy(F.desc("request_id")), path, b"salt", batch="tuesday")
    assert audit.read_log(spark, path).count() == 8
    hot = spark.createDataFrame([event] * 500, LOG)
    assert audit.log_rows(hot, b"salt").select("event_id").distinct().count() == 500
    assert rows(audit.log_rows(hot, b"salt", "x")) == rows(audit.log_rows(hot.repartition(7), b"salt", "x"))
    assert audit.log_rows(hot.limit(0), b"salt").collect() == []
    assert Counter(r.request_id for r in audit.log_rows(first, b"salt").collect())["r1"] == 1
