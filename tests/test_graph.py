import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.operators import graph, knowledge

TRIPLE = ("seq int, subject string, subject_type string, relation string, object string, "
          "object_type string, evidence_tier int, confidence double, source_chunk_id string")


def triples(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TRIPLE)


def plain(s, o, rel="TREATS"):
    return (s, None, rel, o, None, None, None, None)


def test_last_edge_wins_and_defaults(spark):
    df = triples(spark, (" a ", "Peptide", "TREATS", "b", "Condition", 1, .9, "c1"),
                 ("a", None, "INHIBITS", "b", "Model", None, None, None), plain("", "x"), plain(None, "x"))
    edges = graph.build_edges(df).collect()
    assert [tuple(e) for e in edges] == [("a", "b", "INHIBITS", 3, "", .5)]
    nodes = {r.id: r.entity_type for r in graph.build_nodes(df).collect()}
    assert nodes == {"a": "unknown", "b": "Model"}
    assert {r.kind: r.total for r in graph.graph_counts(df).collect()} == {"edges": 1, "nodes": 2}


def test_neighbors_and_self_loop(spark):
    edges = graph.build_edges(triples(spark, plain("a", "a"), plain("a", "b", "CONTRAINDICATED_WITH"),
                                      plain("c", "a")))
    wanted = spark.createDataFrame([("a",), ("a",), ("nobody",)], "entity string")
    got = sorted((r.neighbor, r.direction) for r in graph.neighbors(edges, wanted).collect())
    assert got == [("a", "incoming"), ("a", "outgoing"), ("b", "outgoing"), ("c", "incoming")]
    assert [r.neighbor for r in graph.contraindications(edges, wanted).collect()] == ["b"]


def brute_paths(links, source, target, limit=5):
    out = {}
    for s, t in links:
        out.setdefault(s, set()).add(t)
    found = []

    def walk(path):
        if path[-1] == target:
            found.append(path)
        elif len(path) < 5:
            for n in out.get(path[-1], ()):
                if n not in path:
                    walk(path + [n])
    if source != target:
        walk([source])
    return sorted(found, key=lambda p: (len(p), p))[:limit]


@pytest.mark.parametrize("seed, n, m", [(1, 7, 14), (2, 12, 40), (3, 30, 60), (4, 9, 60)])
def test_paths_against_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    links = {(rng.choice(names), rng.choice(names)) for _ in range(m)}
    # a hub that a third of all links touch
    links |= {("n00", x) for x in names[: n // 2]} | {(x, "n00") for x in names[n // 2:]}
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    pairs = list(itertools.product(names[:6], names[-6:]))
    got = {}
    rows = graph.evidence_paths(edges, spark.createDataFrame(pairs, "source string, target string"))
    for r in rows.orderBy("path_rank").collect():
        got.setdefault((r.source, r.target), []).append(list(r.path))
        assert r.hops == len(r.path) - 1
    simple = [l for l in links if l[0] != l[1]]
    want = {p: brute_paths(simple, *p) for p in pairs}
    assert got == {p: v for p, v in want.items() if v}


def test_parse_claims(spark):
    body = '[{"claim_text": "x", "confidence": 0.9}, {"claim_text": "y"}]'
    rows = [("c1", 1, f"Sure:\n```json\n{body}\n```\nbye"), ("c2", 2, f"```\n{body}\n```"),
            ("c3", 3, '{"claim_text": "single"}'), ("c4", 4, body[:-3]), ("c5", 5, "no json"), ("c6", 5, "[]")]
    df = spark.createDataFrame(rows, "chunk_id string, evidence_tier int, raw string")
    claims = knowledge.parse_claims(df).collect()
    got = sorted((c.source_chunk_id, c.evidence_tier, c.claim_text) for c in claims)
    assert got == [("c1", 1, "x"), ("c1", 1, "y"), ("c2", 2, "x"), ("c2", 2, "y"), ("c3", 3, "single")]
    assert sorted(r.chunk_id for r in knowledge.unparsed_responses(df).collect()) == ["c4", "c5"]
    lines = {r.source_chunk_id: r.claims_text for r in knowledge.claim_lines(knowledge.parse_claims(df)).collect()}
    assert lines["c1"] == "- [1] x\n- [1] y"


def test_parse_triples_vocabulary_and_floor(spark):
    body = ('[{"subject": "a", "relation": "TREATS", "object": "b", "confidence": 0.3},'
            '{"subject": "a", "relation": "LIKES", "object": "b", "confidence": 0.9},'
            '{"subject": "a", "relation": "INHIBITS", "object": "c", "confidence": 0.9}]')
    df = spark.createDataFrame([("c1", f"```json\n{body}\n```"), ("c2", f"```\n{body}\n```")],
                               "chunk_id string, raw string")
    assert sorted(r.relation for r in knowledge.parse_triples(df).collect()) == ["INHIBITS", "TREATS"]
    assert [r.relation for r in knowledge.parse_triples(df, dims.TRIPLE_CONFIDENCE_FLOOR).collect()] == ["INHIBITS"]


def test_link_entities(spark):
    df = triples(spark, plain(" BPC157 ", "Thymosin \u03b2-4"), plain("camp", " Unknown Thing "))
    got = {(r.subject, r.object) for r in knowledge.link_entities(df).collect()}
    assert got == {("BPC-157", "TB-500"), ("LL-37", "Unknown Thing")}


def test_edge_lines(spark):
    edges = graph.build_edges(triples(spark, ("a", None, "TREATS", "b", None, 2, .5, "c")))
    assert graph.edge_lines(edges).collect()[0].value == (
        '{"source":"a","target":"b","relation":"TREATS","evidence_tier":2,"source_chunk_id":"c","confidence":0.5}')


def test_expand_hits(spark):
    edges = graph.build_edges(triples(
        spark, ("a", None, "TREATS", "b", None, 1, .5, "c1"), ("b", None, "TREATS", "d", None, 1, .5, "c2"),
        ("x", None, "TREATS", "y", None, 1, .5, "c3")))
    hits = spark.createDataFrame([("q", "c1")], "query_id string, chunk_id string")
    assert sorted(r.chunk_id for r in graph.expand_hits(hits, edges).collect()) == ["c1", "c2"]


def test_hybrid_takes_its_hit_count_from_the_data(spark):
    """Fifty hits of one query, k = 20: chunks of the graph that outrank hits are not lost."""
    from claimgrain.operators.ranking import hybrid_topk
    hits = spark.createDataFrame([("q", str(i), 0.01 + i / 1e4, i + 1) for i in range(50)] + [("r", "3", 0.9, 1), (None, "4", 0.9, 1)],
                                 "query_id string, id string, similarity double, retrieval_rank int")
    # one hub supports all 120 chunks, hits first in the order of their names
    edges = spark.createDataFrame([("hub", f"e{i}", str(i)) for i in range(120)],
                                  "src string, dst string, source_chunk_id string")
    meta = spark.createDataFrame([(str(i), f"c{i:03d}", 1) for i in range(120)], "id string, chunk_id string, evidence_tier int")
    meta = meta.withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")
    got = hybrid_topk(hits, edges, meta, as_of, k=20).collect()
    for query, own in (("q", range(50)), ("r", [3])):
        pool = [(-round(0.01 + i / 1e4, 9) if query == "q" else -0.9, i + 1 if query == "q" else 1, f"c{i:03d}", False) for i in own]
        pool += [(-0.5, 1_000_000_000, f"c{i:03d}", True) for i in range(120) if i not in own]
        want = [(c, g) for _, _, c, g in sorted(pool)[:20]]
        assert [(r.chunk_id, r.from_graph) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)] == want
    assert hybrid_topk(hits.limit(0), edges, meta, as_of).collect() == []
