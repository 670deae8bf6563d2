"""Mentions in whole texts, ambiguous synonyms, misspelt names, scores that spread over a graph."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.operators import graph, knowledge, mentions
from claimgrain.operators.ranking import hybrid_topk
from claimgrain.plans import registry
from claimgrain.sources import adapters

SF = "/root/testdata/sf0.001"
NAME = "name string, canonical string, ambiguous boolean"
registry.load_all()


def plain_mentions(text, names):
    """Every name at every place, then the longest from left to right."""
    low = mentions.fold(text)
    inner = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    found, free = [], 0
    while free < len(low):
        here = [n for n in names if low.startswith(n, free) and not (inner(free - 1) and inner(free))
                and not (inner(free + len(n) - 1) and inner(free + len(n)))]
        if here:
            best = max(here, key=len)
            found.append((free, free + len(best), best))
            free += len(best)
        else:
            free += 1
    return found


def test_mentions_equal_a_scan_per_name(spark):
    rng = random.Random(1)
    names = ["camp", "camp fire", "fire", "fire c", "bpc-157", "pentadecapeptide bpc-157", "tβ4", "a", "c d e", "d", "(x)", "é"]
    parts = [*names, "CAMP", "camping", "Tβ4", " ", "-", ".", "_", "É", "İ", "xd", "d1", "日本", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += [None, "", "camp " * 20_000, "BPC-157/camp", "İ camp", "camp", "camp"]
    table = spark.createDataFrame([(n, n.upper(), n == "camp") for n in names] + [("", "none", False), (None, "none", False)], NAME)
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "clash")], "id int, key string, text string")
    got = {r.id: r.mentions for r in mentions.find_mentions(rows, table, "id", "key").collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "a")]:
        if t is None or len(t) < 1000:
            assert [(m.start, m.end, m.name) for m in got[i]] == plain_mentions(t or "", names)
    assert len(got[texts.index("camp " * 20_000)]) == 20_000
    assert all(m.ambiguous == (m.name == "camp") and m.canonical == m.name.upper() for ms in got.values() for m in ms)


def test_mentions_of_shared_names_no_names_and_no_texts(spark):
    table = spark.createDataFrame([("ab", "Z", False), ("AB", "Y", False)], NAME)
    rows = spark.createDataFrame([("k", "ab AB")], "chunk_id string, content string")
    got = mentions.find_mentions(rows, table).first().mentions
    assert [(m.canonical, m.ambiguous) for m in got] == [("Y", True)] * 2
    assert mentions.find_mentions(rows, table.limit(0)).first().mentions == []
    assert mentions.find_mentions(rows.limit(0), table).collect() == []


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mentions, "MAX_NAMES", 3)
    names = spark.range(4).select(F.col("id").cast("string").alias("name"), F.lit("c").alias("canonical"), F.lit(False).alias("ambiguous"))
    with pytest.raises(ValueError, match="names"):
        mentions.find_mentions(spark.createDataFrame([("k", "1")], "chunk_id string, content string"), names)


def test_short_plain_synonyms_are_flagged(spark):
    flagged = {r.name for r in knowledge.entity_names(spark).filter("ambiguous").collect()}
    assert flagged == {"camp"}
    triples = spark.createDataFrame([(" CAMP ", "mt2"), ("LL-37", "camp fire"), (None, "")], "subject string, object string")
    got = [tuple(r) for r in knowledge.link_entities(triples, flag=True).collect()]
    assert got == [("LL-37", "Melanotan-II", True, False), ("LL-37", "camp fire", False, False), (None, "", False, False)]
    assert knowledge.link_entities(triples).columns == ["subject", "object"]


# ---- misspelt names ---------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_misspelt_names_equal_all_pairs(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 6)))
    words, names = [make() for _ in range(150)], [make() for _ in range(80)] + ["camp", "日本語"]
    words += ["camps", "cmp", "clamp", "日本", "w" * 5000, *["hot"] * 200]
    a = spark.createDataFrame([(w, 1) for w in words] + [(None, 2)], "word string, name int")
    b = spark.createDataFrame([(n, 1) for n in names] + [(None, 2)], "name string, form int")
    got = Counter(map(tuple, knowledge.misspelt_names(a, b).collect()))
    want = Counter((w, n, edits(w, n)) for w in set(words) for n in set(names)
                   if w and n and abs(len(w) - len(n)) <= 1 and edits(w, n) <= 1)
    assert got == want and ("clamp", "camp", 1) in got
    assert knowledge.misspelt_names(a, b.limit(0)).collect() == []
    assert knowledge.misspelt_names(a.limit(0), b).collect() == []


# ---- scores that spread -------------------------------------------------------------------------

def dense_rank(edges, seeds, restart=0.15, rounds=2000):
    nodes = sorted({n for e in edges for n in e} | {n for n, _ in seeds})
    at = {n: i for i, n in enumerate(nodes)}
    step = np.zeros((len(nodes), len(nodes)))
    for a, b in set(edges):
        step[at[a], at[b]] = 1
    out = step.sum(axis=1)
    step = np.divide(step, out[:, None], out=np.zeros_like(step), where=out[:, None] > 0)
    stop = np.where(out > 0, restart, 1.0)
    walk, score = np.zeros(len(nodes)), np.zeros(len(nodes))
    for n, w in seeds:
        walk[at[n]] += w / sum(w for _, w in seeds)
    for _ in range(rounds):
        score += stop * walk
        walk = (walk * (1 - stop)) @ step
    return {n: score[at[n]] for n in nodes}


@pytest.mark.parametrize("tolerance", [1e-2, 1e-5])
def test_rank_matches_the_dense_iteration(spark, tolerance):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(120)]
    edges += [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(0, 40, 2)] + [("n1", "sink"), ("x", "x")]
    seeds = {"q": [("hub", 1.0)], "r": [("n1", 3.0), ("n2", 1.0)], "lone": [("nowhere", 2.0)], "loop": [("x", 1.0)]}
    table = spark.createDataFrame(edges + edges[:9] + [("n1", None)], "src string, dst string")
    asked = spark.createDataFrame([(k, n, w) for k, own in seeds.items() for n, w in own]
                                  + [("q", None, 1.0), (None, "n1", 1.0), ("q", "n3", 0.0), ("none", "n3", -1.0)],
                                  "query_id string, node string, weight double")
    got = graph.personalised_rank(table, asked, tolerance=tolerance).collect()
    assert {r.query_id for r in got} == set(seeds)
    for name, own in seeds.items():
        true, mine = dense_rank(edges, own), {r.node: r.score for r in got if r.query_id == name}
        missing = {r.missing for r in got if r.query_id == name}.pop()
        degrees = Counter(a for a, _ in set(edges))
        assert missing <= tolerance * sum(max(degrees[n], 1) for n in true) + 1e-9
        for n, t in true.items():
            assert -1e-9 <= t - mine.get(n, 0.0) <= missing + 1e-9
    assert graph.personalised_rank(table, asked.limit(0)).collect() == []
    lone = graph.personalised_rank(table.limit(0), asked.filter("query_id = 'q'")).collect()
    assert [(r.node, r.score) for r in lone] == [("hub", 1.0)]


def test_rank_over_the_whole_graph(spark):
    edges = [(r.src, r.dst) for r in adapters.edges(spark, SF).collect()]
    got = registry.QUERIES["graph_rank"](spark, SF).collect()
    for name in sorted({r.query_id for r in got})[:5]:
        true, mine = dense_rank(edges, [(name, 1.0)], rounds=300), {r.node: (r.score, r.missing) for r in got if r.query_id == name}
        missing = next(iter(mine.values()))[1]
        assert all(-1e-9 <= t - mine.get(n, (0.0,))[0] <= missing + 1e-9 for n, t in true.items())


def test_hybrid_ranking_by_spread_relevance(spark):
    """Chunks near the hits' entities go before chunks far away, which all were alike before."""
    edges = spark.createDataFrame([("a", "b", "c1"), ("b", "c", "c2"), ("c", "d", "c3"), ("d", "e", "c4"), ("b", "a", "c5")],
                                  "src string, dst string, source_chunk_id string")
    hits = spark.createDataFrame([("q", "c1", 0.9, 1)], "query_id string, id string, similarity double, retrieval_rank int")
    meta = spark.createDataFrame([(f"c{i}", f"c{i}", 1) for i in range(1, 6)], "id string, chunk_id string, evidence_tier int")
    meta = meta.withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    spread = graph.spread_relevance(hits, edges, tolerance=1e-6)
    near = {r.id: r.relevance for r in spread.collect()}
    assert near["c1"] == near["c2"] == near["c5"] == 1.0 and 1 > near["c3"] > near["c4"] > 0
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")
    flat = hybrid_topk(hits, edges, meta, as_of, k=5)
    assert [r.chunk_id for r in sorted(flat.collect(), key=lambda r: r.rank)] == ["c1", "c2", "c5"]
    got = hybrid_topk(hits, edges, meta, as_of, k=5, relevance=spread)
    assert [r.chunk_id for r in sorted(got.collect(), key=lambda r: r.rank)] == ["c1", "c2", "c5", "c3", "c4"]
    assert hybrid_topk(hits.limit(0), edges, meta, as_of, relevance=spread.limit(0)).collect() == []


def test_synonyms_are_those_of_the_list(spark):
    assert knowledge.entity_names(spark).count() == len({n.lower() for c, ns in dims.SYNONYMS.items() for n in [c, *ns]})
