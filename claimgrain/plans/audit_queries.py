"""Audit-log and job-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import ids
from claimgrain.operators import audit, timeline
from claimgrain.plans import sqltext as q
from claimgrain.plans.registry import register
from claimgrain.session import stored
from claimgrain.sources import adapters as ad

# Shown in the oracle SQL too, so it protects nothing: deployments pass their own salt.
SAMPLE_SALT = b"sample salt for the public test tables"
_INNER, _OUTER = ids.hmac_pads(SAMPLE_SALT)
_IP_HASH = (f"CASE WHEN ip = '' THEN '' ELSE substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') "
            f"|| encode(ip)))), 1, {dims.IP_HASH_CHARS}) END")

_WHERE = dict(event_type="chat_query", role="clinician", since="2024-01-03 00:00:00",
              until="2024-01-25 00:00:00", prefix="a")
_SQL_WHERE = """WHERE event_type = 'chat_query' AND role = 'clinician' AND "timestamp" >= TIMESTAMP '2024-01-03'
  AND "timestamp" <= TIMESTAMP '2024-01-25' AND starts_with(request_id, 'a')"""


def _at(name):
    return ids.isoformat(F.col(name)).alias(name)


@register("audit_search", q.query(q.AUDIT, f"""
SELECT event_id, event_type, {q.iso('"timestamp"')} AS "timestamp", request_id, role, data FROM audit {_SQL_WHERE}
ORDER BY audit."timestamp" DESC, event_id DESC LIMIT 100 OFFSET 5"""))
def audit_search(spark, sf):
    page = audit.search_events(ad.audit_events(spark, sf), limit=100, offset=5, **_WHERE)
    return page.select("event_id", "event_type", _at("timestamp"), "request_id", "role", "data")


@register("audit_count", q.query(q.AUDIT, f"SELECT count(*) AS total FROM audit {_SQL_WHERE}"))
def audit_count(spark, sf):
    return audit.count_events(ad.audit_events(spark, sf), **_WHERE)


@register("audit_pseudonymize", q.query(q.AUDIT, f"""
SELECT event_id, event_type, {_IP_HASH} AS ip_hash, substr({q.sha('data')}, 1, 16) AS query_hash FROM audit"""))
def audit_pseudonymize(spark, sf):
    return audit.pseudonymize(ad.audit_events(spark, sf), SAMPLE_SALT).select(
        "event_id", "event_type", "ip_hash", ids.query_hash(F.col("data")).alias("query_hash"))


@register("audit_append", q.query(q.AUDIT, f"""
SELECT sha256(concat_ws(chr(31), body, request_id)) AS event_id, event_type, "timestamp", request_id, role, data, ip_hash
FROM (SELECT event_type, stamp AS "timestamp", role, data, ip_hash, body,
    CASE WHEN event_id % 3 = 0 THEN substr(sha256('request' || chr(31) || body), 1, 32) ELSE request_id END AS request_id
  FROM (SELECT *, concat_ws(chr(31), stamp, event_type, role, data, ip_hash) AS body
    FROM (SELECT *, {q.iso('"timestamp"')} AS stamp, {_IP_HASH} AS ip_hash FROM audit)))"""))
def audit_append(spark, sf):
    """Rows as they are appended to the log; a third of the events come without a request id."""
    events = ad.audit_events(spark, sf).withColumn("request_id", F.when(
        F.col("event_id") % 3 != 0, F.col("request_id"))).drop("event_id")
    return audit.log_rows(events, SAMPLE_SALT).withColumn("timestamp", _at("timestamp"))


@register("audit_payload", q.query(q.AUDIT, """
SELECT event_id, json_valid(data) AS valid_json,
  CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.k') AS BIGINT) END AS k FROM audit"""))
def audit_payload(spark, sf):
    return audit.decode_payload(ad.audit_events(spark, sf), "$.k", "bigint", "k").select(
        "event_id", "valid_json", "k")


@register("audit_retention", q.query(q.AUDIT, """
SELECT event_type, count(*) AS kept FROM audit
WHERE "timestamp" >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAYS GROUP BY event_type"""))
def audit_retention(spark, sf):
    kept = audit.retained(ad.audit_events(spark, sf), ad.ntz("2024-04-15 00:00:00"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


ALERTS_SQL = q.query(q.AUDIT, """
SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events,
  round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
  round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms,
  avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END) > 0.01 AS error_alert,
  quantile_cont(latency_ms, 0.99) > 5000 AS latency_alert
FROM audit GROUP BY date_trunc('hour', "timestamp")""")


def rounded_alerts(alerts):
    return alerts.withColumn("error_rate", F.round("error_rate", 6)).withColumn(
        "p99_ms", F.round("p99_ms", 4))


@register("audit_alerts", ALERTS_SQL)
def audit_alerts(spark, sf):
    return rounded_alerts(audit.window_alerts(ad.audit_events(spark, sf)))


@register("audit_alerts_merged", ALERTS_SQL)
def audit_alerts_merged(spark, sf):
    """The hourly alerts from partial counts of parts of the log, added up."""
    events = ad.audit_events(spark, sf)
    parts = [audit.alert_partials(events.filter(F.col("event_id") % 3 == part)) for part in range(3)]
    return rounded_alerts(audit.partial_alerts(parts[0].unionByName(parts[1]).unionByName(parts[2])))


@register("latency_trend")
def latency_trend(spark, sf):
    """Daily and sliding six-hour alerts, all merged from one stored sketch per hour."""
    hours = stored(audit.hourly_sketches(ad.audit_events(spark, sf)), "hours")
    spans = [("day", audit.sketch_alerts(hours, "1 day")),
             ("6 hours", audit.sketch_alerts(hours, "6 hours", "1 hour"))]
    days, sliding = (alerts.select(F.lit(span).alias("span"), "*") for span, alerts in spans)
    return days.unionByName(sliding)


@register("audit_export", q.query(q.AUDIT, f"""
SELECT event_id, event_type, {q.iso('"timestamp"')} AS "timestamp", request_id, role,
  replace(data, '": ', '":') AS data, {_IP_HASH} AS ip_hash FROM audit WHERE json_valid(data)
UNION ALL SELECT event_id, event_type, {q.iso('"timestamp"')}, request_id, role, data, {_IP_HASH}
FROM audit WHERE NOT json_valid(data)"""))
def audit_export(spark, sf):
    return audit.csv_rows(audit.pseudonymize(ad.audit_events(spark, sf), SAMPLE_SALT))


_JOB = f"""job_id, source_type, {q.iso('triggered_at')} AS triggered_at, {q.iso('completed_at')} AS completed_at,
  status, total_chunks, error"""


def _job_row(jobs):
    return jobs.select("job_id", "source_type", _at("triggered_at"), _at("completed_at"), "status",
                       "total_chunks", "error")


@register("job_state", q.query(q.JOBS, f"SELECT {_JOB} FROM jobs"))
def job_state(spark, sf):
    return _job_row(ad.jobs(spark, sf))


@register("job_search", q.query(q.JOBS, f"""
SELECT {_JOB}, total_chunks AS result_count FROM jobs WHERE source_type = 'website' AND status = 'completed'
ORDER BY jobs.triggered_at DESC, job_id DESC LIMIT 200 OFFSET 3"""))
def job_search(spark, sf):
    page = audit.search_jobs(ad.jobs(spark, sf), source_type="website", status="completed",
                             limit=1000, offset=3)
    count = F.get_json_object("results", "$.count").cast("bigint").alias("result_count")
    return page.select("job_id", "source_type", _at("triggered_at"), _at("completed_at"), "status",
                       "total_chunks", "error", count)


@register("job_lookup", q.query(q.JOBS, """
SELECT w.job_id, j.status FROM (SELECT CAST(c_custkey * 20 AS VARCHAR) AS job_id FROM customer) w
LEFT JOIN jobs j USING (job_id)"""))
def job_lookup(spark, sf):
    wanted = ad.table(spark, sf, "customer").select(
        (F.col("c_custkey") * 20).cast("string").alias("job_id"))
    return audit.get_jobs(ad.jobs(spark, sf), wanted).select("job_id", "status")


@register("latest_job", q.query(q.JOBS, f"""
SELECT status, {q.iso('triggered_at')} AS last_run_at, error, job_id FROM jobs
ORDER BY jobs.triggered_at DESC, job_id DESC LIMIT 1"""))
def latest_job(spark, sf):
    return audit.pipeline_status(ad.jobs(spark, sf)).select(
        "status", _at("last_run_at"), "error", "job_id")


@register("job_conflict", q.query(q.JOBS, "SELECT count(*) > 0 AS conflict FROM jobs WHERE status = 'running'"))
def job_conflict(spark, sf):
    return audit.running_conflict(ad.jobs(spark, sf))


@register("job_outcome", q.query(q.RESULTS, """
SELECT job_id, n AS count, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN failed THEN 'source unreachable' END AS error FROM results"""))
def job_outcome(spark, sf):
    return audit.job_outcome(ad.run_results(spark, sf)).select("job_id", "count", "status", "error")


@register("job_concurrency", q.query(q.JOBS + """,
spans AS (SELECT job_id, source_type, triggered_at AS s, coalesce(completed_at, TIMESTAMP '9999-01-01') AS e FROM jobs),
meets AS (SELECT a.source_type, a.job_id, count(*) AS n FROM spans a
  JOIN spans b ON a.source_type = b.source_type AND b.s <= a.s AND a.s < b.e GROUP BY ALL),
pairs AS (SELECT a.source_type, count(*) AS n FROM spans a JOIN spans b ON a.source_type = b.source_type
  AND a.job_id < b.job_id AND a.s < b.e AND b.s < a.e GROUP BY ALL)""", """
SELECT m.source_type, count(*) AS intervals, max(m.n) AS peak, coalesce(any_value(p.n), 0) AS conflicts
FROM meets m LEFT JOIN pairs p USING (source_type) GROUP BY m.source_type"""))
def job_concurrency(spark, sf):
    """How many jobs of a source ran at once, and how many pairs of them would have conflicted."""
    return timeline.concurrency(ad.jobs(spark, sf), "source_type", "triggered_at", "completed_at")
