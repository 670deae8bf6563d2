"""As-of joins, running counts, deduplication across runs."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgrain.operators import seen, timeline

T0 = dt.datetime(2024, 1, 1)
LEFT = "id int, source string, at timestamp_ntz, asked string"
RIGHT = "source string, since timestamp_ntz, till timestamp_ntz, tier int"


def minute(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


def plain_as_of(left, right, until):
    out = []
    for row in left:
        _, source, at, _ = row
        valid = [g for g in right if g[0] == source and None not in (source, at, g[1]) and g[1] <= at]
        best = max(valid, key=lambda g: (g[1], g[2] is not None, g[2] or T0, g[3]), default=None)
        if until and best and best[2] is not None and not at < best[2]:
            best = None
        out.append((*row, best))
    return Counter(out)


@pytest.mark.parametrize("until", [None, "till"])
def test_as_of_join_equals_the_plain_one(spark, until):
    rng = random.Random(5)
    pick = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only left", None])
    left = [(i, pick(), minute(rng.choice([None, *range(60)])), "x") for i in range(400)]
    left += [(1000 + i, "hot", minute(30), "same time") for i in range(300)] + [(7, "a", minute(3), "again")] * 2
    right = [(rng.choice(["hot", "hot", "a", "b", "only right", None]), minute(rng.choice([None, *range(60)])),
              minute(rng.choice([None, *range(70)])), rng.randrange(5)) for _ in range(150)]
    right += [("hot", minute(20), None, 1), ("hot", minute(20), None, 4), ("hot", minute(20), None, 4)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = timeline.as_of_join(a.repartition(5), b.repartition(3), "source", "at", "since", until)
    assert got.columns == ["id", "source", "at", "asked", "asof"]
    assert Counter((r.id, r.source, r.at, r.asked, r.asof and tuple(r.asof)) for r in got.collect()) == plain_as_of(left, right, until)


def test_as_of_join_of_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", T0, "q")], "key int, time string, part timestamp_ntz, `a.b` string")
    right = spark.createDataFrame([("a", T0, 3)], "time string, side timestamp_ntz, tie int")
    row = timeline.as_of_join(left, right, "time", "part", "side").first()
    assert (row.key, row["a.b"], row.asof.tie) == (1, "q", 3)
    assert timeline.as_of_join(left, right.limit(0), "time", "part", "side").first().asof is None
    assert timeline.as_of_join(left.limit(0), right, "time", "part", "side").collect() == []


def test_a_hot_key_lies_in_many_ranges(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") % 5000).alias("time"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(small)
    spark.conf.set(small, "false")  # else a table this small is one range
    try:
        parts = timeline._ranged(rows, ["time"]).groupBy("part").count().collect()
    finally:
        spark.conf.set(small, was)
    assert len(parts) > 1 and max(r["count"] for r in parts) < 12_000


def test_concurrency_equals_the_pairs(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        s = rng.choice([None, *range(80)])
        e = rng.choice([None, (s or 0) + rng.randrange(-2, 12)])
        data.append((rng.choice(["hot"] * 5 + ["b", "c", None]), minute(s), minute(e)))
    got = timeline.concurrency(spark.createDataFrame(data, "k string, s timestamp_ntz, e timestamp_ntz").repartition(4), "k", "s", "e")
    own = {}
    for k, s, e in data:
        if k and s and (e is None or s < e):
            own.setdefault(k, []).append((s, e or dt.datetime.max))
    want = {}
    for k, spans in own.items():
        pairs = sum(a[0] < b[1] and b[0] < a[1] for i, a in enumerate(spans) for b in spans[i + 1:])
        want[k] = (len(spans), max(sum(s <= t < e for s, e in spans) for t, _ in spans), pairs)
    assert {r.k: (r.intervals, r.peak, r.conflicts) for r in got.collect()} == want
    assert timeline.concurrency(spark.createDataFrame([], "k string, s timestamp_ntz, e timestamp_ntz"), "k", "s", "e").collect() == []


# ---- runs that know what others have seen -------------------------------------------------------

def batch(spark, *keys):
    return spark.createDataFrame([(i, k, "clash") for i, k in enumerate(keys)], "n int, content_hash string, bucket string")


def kept(df):
    return Counter((r.n, r.content_hash) for r in df.collect())


def test_runs_admit_what_none_before_had(spark, tmp_path):
    path = str(tmp_path / "seen")
    first = batch(spark, "a", "b", "a", None, None, *["hot"] * 500)
    assert kept(seen.admit(first, path, 1, order=["n"])) == Counter({(0, "a"): 1, (1, "b"): 1, (3, None): 1, (4, None): 1, (5, "hot"): 1})
    second = batch(spark, "c", "b", "hot", "c", "d")
    want = Counter({(0, "c"): 1, (4, "d"): 1})
    assert kept(seen.admit(second, path, 2, order=["n"])) == want
    assert kept(seen.admit(second.repartition(4), path, 2, order=["n"])) == want  # the run again
    assert kept(seen.admit(batch(spark, "a", "d", "e"), path, 3)) == Counter({(2, "e"): 1})
    assert kept(seen.admit(first.limit(0), path, 4)) == Counter()
    assert kept(seen.admit(batch(spark, "e", "f"), path, 5)) == Counter({(1, "f"): 1})


def test_a_lost_run_does_not_count(spark, tmp_path):
    path = str(tmp_path / "seen")
    seen.admit(batch(spark, "a"), path, 1)
    os.remove(f"{path}/filter/run=1/_SUCCESS")  # as if the job had died before its end
    assert kept(seen.admit(batch(spark, "a"), path, 2)) == Counter({(0, "a"): 1})


def test_a_second_run_reads_a_small_part_of_the_store(spark, tmp_path):
    path = str(tmp_path / "seen")
    many = spark.range(30_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("content_hash"))
    assert seen.admit(many, path, 1, buckets=256).count() == 30_000
    again = spark.range(29_990, 30_200).select(F.md5(F.col("id").cast("string").cast("binary")).alias("content_hash"))
    hashes = again.select(F.col("content_hash").alias("hash"), seen._number("content_hash").alias("number")).withColumn(
        "bucket", F.pmod("number", F.lit(256)).cast("int"))
    suspects = {r["hash"] for r in seen.maybe_seen(spark, hashes, path, 2).collect()}
    repeats = {r.content_hash for r in again.limit(10).collect()}
    assert repeats <= suspects and len(suspects) <= 10 + 8   # one in 250 of 200 is expected to pass
    touched = [r["bucket"] for r in hashes.filter(F.col("hash").isin(list(suspects))).select("bucket").distinct().collect()]
    part = seen.seen_hashes(spark, path, 2).filter(F.col("bucket").isin(touched))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert part.count() <= 18 / 256 * 30_000 * 1.5
    assert seen.admit(again, path, 2, buckets=256).count() == 200
