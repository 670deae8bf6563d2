import datetime as dt
import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import ids, scoring
from claimgrain.operators import answers, ranking

TS = dt.datetime(2024, 1, 2, 3, 4, 5)


def test_document_id_from_url(value):
    url = "https://example.org/p\u00e4ge"
    got = value(ids.document_id(F.col("a"), F.lit(TS), F.lit("n")), row=(url,))
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, url))


@pytest.mark.parametrize("micros", [0, 123, 500000])
def test_document_id_from_name_and_time(value, micros):
    ts = TS.replace(microsecond=micros)
    got = value(ids.document_id(F.lit(""), F.col("t"), F.col("a")), "a string, t timestamp_ntz",
                ("source", ts))
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"source::{ts.isoformat()}"))


def test_missing_time_stays_missing(value):
    assert value(ids.isoformat(F.col("t")), "t timestamp_ntz") is None


@pytest.mark.parametrize("salt", [b"s", b"x" * 100])
def test_ip_pseudonym(value, salt):
    want = hmac.new(salt, b"10.0.0.1", hashlib.sha256).hexdigest()[:24]
    assert value(ids.ip_pseudonym(F.col("a"), salt), row=("10.0.0.1",)) == want
    assert value(ids.ip_pseudonym(F.col("a"), salt), row=("",)) == ""


@pytest.mark.parametrize("text, ok", [
    ("abc-1_2:3.4", True), ("\u00e9t\u00e9", True), ("a/b", False), ("../x", False), ("", False),
    ("a b", False), ("a\n", False), (None, False)])
def test_valid_id(value, text, ok):
    assert value(ids.valid_id(F.col("a")), row=(text,)) is ok


@pytest.mark.parametrize("tier, weight", [(1, 1.0), (2, .85), (3, .65), (4, .4), (5, .15), (99, .4)])
def test_tier_weight(value, tier, weight):
    assert value(scoring.tier_weight(F.col("a")), "a int", (tier,)) == weight


def test_tier_weights_fall():
    weights = [dims.TIER_WEIGHTS[t] for t in range(1, 6)]
    assert weights == sorted(weights, reverse=True)


@pytest.mark.parametrize("kind, tier", [
    ("pubmed", 1), ("document", 2), ("pdf", 2), ("website", 3), ("youtube", 3), ("skool_course", 3),
    ("skool_community", 4), ("forum", 4), ("anecdotal", 5), ("nothing", 3), ("PUBMED", 1)])
def test_source_type_tier(value, kind, tier):
    assert value(scoring.source_type_tier(F.col("a")), row=(kind,)) == tier


def test_name_wins_over_type(value):
    assert value(scoring.infer_tier(F.lit("forum"), F.col("a")), row=("The Cochrane Library",)) == 1
    assert value(scoring.infer_tier(F.lit("forum"), F.col("a"))) == 4


@pytest.mark.parametrize("tier, label", [(1, "Peer-Reviewed Research"), (5, "Anecdotal"), (9, "Tier 9")])
def test_tier_label(value, tier, label):
    assert value(scoring.tier_label(F.col("a")), "a int", (tier,)) == label


@pytest.mark.parametrize("tier, sim, published, want", [
    (1, .87, dt.datetime(2023, 6, 15), .870),
    (3, .91, dt.datetime(2023, 11, 20), .5915),
    (4, .79, dt.datetime(2018, 3, 10), .237),
    (1, None, None, .5),
    (2, -.5, None, -.425)])
def test_worked_ranking_examples(value, tier, sim, published, want):
    as_of = F.lit(dt.datetime(2024, 6, 30)).cast("timestamp_ntz")
    got = value(scoring.evidence_score(F.col("t"), F.col("s"), F.col("p"), as_of),
                "t int, s double, p timestamp_ntz", (tier, sim, published))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("days, boost", [(0, 1.0), (730, 1.0), (731, .9), (1826, .9), (1827, .75), (-3, 1.0)])
def test_recency_borders(value, days, boost):
    as_of = dt.datetime(2024, 6, 30, 12)
    got = value(scoring.recency_boost(F.col("p"), F.lit(as_of).cast("timestamp_ntz")),
                "p timestamp_ntz", (as_of - dt.timedelta(days=days),))
    assert got == boost


def test_equal_scores_keep_retrieval_order(spark):
    rows = [("q", "a", 2, 1, 1.0, None), ("q", "b", 1, 1, 1.0, None), ("q", "c", 3, 1, 0.2, None)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, retrieval_rank int, "
                                       "evidence_tier int, similarity double, published_at timestamp_ntz")
    ranked = ranking.rank_evidence(hits, F.lit(TS).cast("timestamp_ntz")).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked] == ["b", "a", "c"]


@pytest.mark.parametrize("tiers, score, label", [
    ([1, 1, 1, 1, 1], 1.0, "high"), ([1, 3, 4], .5808, "medium"), ([5], .105, "insufficient"),
    ([2, 2], .595, "medium"), ([4], .28, "low")])
def test_confidence(spark, tiers, score, label):
    ranked = spark.createDataFrame([("q", t) for t in tiers], "query_id string, evidence_tier int")
    row = answers.confidence(ranked).collect()[0]
    assert (row.confidence, row.label) == (score, label)


def test_evidence_summary(spark):
    ranked = spark.createDataFrame([("q", t) for t in [1, 3, 3]], "query_id string, evidence_tier int")
    got = answers.evidence_summary(ranked).collect()[0]["evidence_summary"]
    assert got == ("1 peer-reviewed research source | 2 educational content sources"
                   " | Confidence: medium (65%)")
