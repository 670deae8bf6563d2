from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrain.functions.embedding import hash_vector
from claimgrain.operators import quantised, retrieval


def frame(spark, name, ids, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} string, vector array<double>").repartition(5)


def brute(qs, q, ids, m, k):
    unit = lambda x: x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    scores = np.round(unit(q) @ unit(m).T, 9)
    out = {}
    for i, name in enumerate(qs):
        order = sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:k]
        out[name] = [ids[j] for j in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "retrieval_rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    m = rng.standard_normal((400, 16))
    m[100:240] = m[7]          # a third of the corpus are copies of one vector
    m[399] = 0
    ids = [f"c{i:03d}" for i in rng.permutation(400)]
    q = np.vstack([m[7] + 0.01, rng.standard_normal((9, 16))])
    return ids, m, [f"q{i}" for i in range(10)], q


@pytest.mark.parametrize("k", [1, 5, 150, 1000])
def test_scan_layout_is_exact(spark, data, k):
    ids, m, qs, q = data
    got = retrieval.vector_topk(frame(spark, "query_id", qs, q), frame(spark, "id", ids, m), k)
    assert collected(got) == brute(qs, q, ids, m, k)


@pytest.mark.parametrize("rows", [37, 1000])
def test_block_layout_is_exact(spark, data, rows, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 3 * 64 * 8)
    ids, m, qs, q = data
    got = retrieval.vector_topk(frame(spark, "query_id", qs, q), frame(spark, "id", ids, m), 20,
                                max_broadcast=2, rows_per_block=rows)
    assert collected(got) == brute(qs, q, ids, m, 20)


def test_empty_sides(spark, data):
    ids, m, qs, q = data
    none = frame(spark, "id", ids, m).filter("false")
    assert retrieval.vector_topk(frame(spark, "query_id", qs, q), none, 3).count() == 0
    no_queries = frame(spark, "query_id", qs, q).filter("false")
    assert retrieval.vector_topk(no_queries, frame(spark, "id", ids, m), 3).count() == 0


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 64)) * 2
    m = centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 64)) * 0.5
    ids = [f"c{i:03d}" for i in range(600)]
    q = m[::40]
    qs = [f"q{i}" for i in range(len(q))]
    got = collected(retrieval.ann_topk(frame(spark, "query_id", qs, q), frame(spark, "id", ids, m), 10,
                                       rows_per_block=50))
    want = brute(qs, q, ids, m, 10)
    recall = np.mean([len(set(got.get(n, [])) & set(want[n])) / 10 for n in qs])
    assert recall >= 0.9


@pytest.mark.parametrize("bits", [4, 8, 12, 16])
def test_ann_recall_does_not_fall_with_bits(spark, bits):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 64))
    m = centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 64)) * 0.5  # cosine about 0.8
    ids = [f"c{i:03d}" for i in range(600)]
    q = m[::12]
    qs = [f"q{i}" for i in range(len(q))]
    got = collected(retrieval.ann_topk(frame(spark, "query_id", qs, q), frame(spark, "id", ids, m), 10,
                                       bits=bits))
    want = brute(qs, q, ids, m, 10)
    recall = np.mean([len(set(got.get(n, [])) & set(want[n])) / 10 for n in qs])
    print(f"bits {bits} recall {recall:.3f}")
    assert recall >= 0.9


@pytest.mark.parametrize("bits", range(4, 17))
def test_ann_radius_reaches_the_asked_recall(bits):
    def met(radius):
        return sum(comb(bits, r) * p ** r * (1 - p) ** (bits - r) for r in range(radius + 1))

    p = np.arccos(0.8) / np.pi
    radius = retrieval.ann_radius(bits, 0.8, 0.9)
    assert met(radius) >= 0.9 > met(radius - 1)


def test_ann_with_all_probes_is_exact(spark, data):
    ids, m, qs, q = data
    got = retrieval.ann_topk(frame(spark, "query_id", qs, q), frame(spark, "id", ids, m), 7, dimensions=16,
                             bits=3, probe_bits=3, rows_per_block=20)
    assert collected(got) == brute(qs, q, ids, m, 7)


def test_hash_vector(spark):
    df = spark.createDataFrame([("The the cat",), ("",), (None,)], "t string")
    rows = [r.v for r in df.select(hash_vector(F.col("t")).alias("v")).collect()]
    assert sorted(x for x in rows[0] if x) == [1.0, 2.0] and len(rows[0]) == 64
    assert sum(rows[1]) == sum(rows[2]) == 0


def test_hydrate_defaults(spark):
    df = spark.createDataFrame([("", None, "", None, None)],
                               "source_type string, source_name string, source_url string, "
                               "evidence_tier int, acquired_at timestamp_ntz")
    row = retrieval.hydrate(df).collect()[0]
    assert (row.source_type, row.source_name, row.source_url, row.evidence_tier) == (
        "unknown", "Unknown Source", None, 3)
    assert str(row.acquired_at) == "2024-01-01 00:00:00"


# ---- trained index ----------------------------------------------------------------------------

def clustered(spark, n, seed=5, hot=0):
    """Loose clusters in 64 dimensions, as many as vary with the size; ``hot`` rows near one point."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(8, n // 100), 64))
    rows = centres[rng.integers(0, len(centres), n)] + 0.6 * rng.standard_normal((n, 64))
    rows[:hot] = centres[0] + 0.05 * rng.standard_normal((hot, 64))
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rows)], "id string, vector array<double>")


def recall(found, exact):
    got, want = ({(r.query_id, r.id) for r in df.collect()} for df in (found, exact))
    return len(got & want) / len(want)


@pytest.mark.parametrize("n", [1_500, 6_000, 24_000])
def test_trained_index_recall_at_ten(spark, n):
    """All queries lie inside a tight group of a third of the rows."""
    corpus = clustered(spark, n, hot=n // 3)
    queries = corpus.filter("id % 20 = 0").limit(300).withColumnRenamed("id", "query_id")
    found = quantised.quantised_topk(queries, corpus, 10)
    reached = recall(found, retrieval.vector_topk(queries, corpus, 10))
    print(f"{n} rows recall {reached:.3f}")
    assert reached >= 0.9


def test_trained_index_bounds_its_blocks(spark):
    corpus = clustered(spark, 3_000, hot=1_000)
    quantiser = quantised.train(corpus, dimensions=64)
    indexed = quantised.index(corpus, quantiser).cache()
    assert indexed.count() == 3_000 and {len(r.code) for r in indexed.collect()} == {16}
    cut = indexed.join(quantised.cut_cells(indexed, 50), "cell").withColumn(
        "cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    assert cut.groupBy("cell", "cut").count().agg(F.max("count")).first()[0] <= 100
    queries = corpus.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    whole = quantised.search(queries, corpus, indexed, quantiser, 5)
    small = quantised.search(queries, corpus, indexed, quantiser, 5, rows_per_block=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))


def test_trained_index_similarities_are_exact(spark):
    """With every cell probed and every row a candidate the result is the exact one, ties by id."""
    corpus = clustered(spark, 400).unionByName(clustered(spark, 40, hot=0).selectExpr("concat('copy', id) AS id", "vector"))
    corpus = corpus.unionByName(spark.createDataFrame([("none", None), ("zero", [0.0] * 64)], corpus.schema))
    quantiser = quantised.train(corpus, dimensions=64)
    quantiser.probes = len(quantiser.centres)
    indexed = quantised.index(corpus, quantiser)
    queries = corpus.filter("try_cast(id AS INT) % 40 = 0").withColumnRenamed("id", "query_id")
    found = quantised.search(queries, corpus, indexed, quantiser, 5, candidates=1000)
    exact = retrieval.vector_topk(queries, corpus.filter("vector IS NOT NULL"), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
    empty = corpus.limit(0)
    assert quantised.quantised_topk(queries, empty, 5).collect() == []
    assert quantised.quantised_topk(queries.limit(0), corpus, 5).collect() == []


@pytest.mark.parametrize("name, k, column", [("quantised_topk", 10, "vec_id"), ("ann_topk", 10, "chunk_id")])
def test_recall_of_the_registered_queries(spark, name, k, column):
    """Measured on the given vectors, whole table."""
    from claimgrain.plans import registry
    registry.load_all()
    sf = "/root/testdata/sf0.01"
    got = {(r.query_id, r[column]) for r in registry.QUERIES[name](spark, sf).collect()}
    if name == "ann_topk":
        want = {(r.query_id, r.chunk_id) for r in registry.QUERIES["vector_topk"](spark, sf).collect()}
    else:
        vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr(
            "CAST(vec_id AS STRING) AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS vector")
        asked = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
        want = {(r.query_id, r.id) for r in retrieval.vector_topk(asked, vectors, k).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_a_query_hands_on_its_best_per_block_not_per_cell():
    """Also with many copies: of equal scores the smaller ids stay."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    unit = retrieval._unit(rng.standard_normal((400, 8)))
    unit[200:] = unit[:200]
    quantiser = quantised.Quantiser(unit[:16], np.ones(16), rng.standard_normal((4, 32, 2)) * 0.3, 9)
    cells = quantiser.nearest(unit, 1)[:, 0]
    codes = quantiser.codes(unit, cells)
    ids = rng.permutation([f"v{i:03}" for i in range(400)]).tolist()
    rows = pa.table({"id": ids, "cell": pa.array(cells, pa.int32()), "code": [c.tobytes() for c in codes],
                     "along": (unit * quantiser.centres[cells]).sum(axis=1)})
    asks = pa.table({"query_id": [str(i) for i in range(40)], "vector": unit[:40].tolist()})
    found = {}
    for who, at, near in quantised._block_topk(rows, asks, quantiser, 7):
        for q, r in zip(who, at):
            found.setdefault(int(q), set()).add(ids[r])
    probed = quantiser.nearest(unit[:40], 9)
    for q in range(40):
        score = {}
        for r in np.flatnonzero(np.isin(cells, probed[q])):
            rest = np.concatenate([quantiser.books[p, codes[r, p]] for p in range(4)])
            centre = quantiser.centres[cells[r]]
            score[ids[r]] = round(float((unit[q] - centre) @ rest + unit[q] @ centre - centre @ centre
                                        + unit[r] @ centre), 9)
        assert found[q] == set(sorted(score, key=lambda i: (-score[i], i))[:7])
