"""Shards, mixture, vector search, near-duplicate join, components and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimgrain.llm import common, mixing, ngram_join, queries, sharding, vector_search
from claimgrain.llm.components import connected_components
from tests.llm.conftest import HARD_TEXTS

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- shards -------------------------------------------------------------------------------
def check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
        by[r.shard].append(r)
    assert len(rows) == len(texts) and set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    share, widest = sum(r.size for r in rows) / shards, max(r.size for r in rows)
    assert all(abs(sum(r.size for r in by[s]) - share) <= widest for s in range(shards))


def test_shards(spark, docs):
    random.seed(3)
    texts = dict(enumerate(HARD_TEXTS + ["copy " * 9] * 300 + ["r" * random.randrange(400) for _ in range(500)]))
    texts[None] = "nobody"
    for shards in (1, 7, 40):
        check_shards(sharding.byte_shards(docs(list(texts.items())), shards=shards).collect(), texts, shards)
    assert sharding.byte_shards(docs([])).collect() == []
    few = sharding.byte_shards(docs([(1, "a"), (1, "a"), (2, None)]), shards=40).collect()
    assert len(few) == 3 and sorted(r.size for r in few) == [16, 17, 17]


def test_shards_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, second = ({tuple(r) for r in queries.op5(spark, SF).collect()} for _ in range(2))
    assert first == second
    check_shards(queries.op5(spark, SF).collect(), texts, 40)


# ---- mixture ------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
        if not over:
            break
        rest, open_ = rest - sum(target[s] for s in over), open_ - over
    return target


def test_mixture(spark, docs):
    random.seed(5)
    rows = [(i, "w " * random.randrange(60), None, random.choice(["hot", "hot", "hot", "b", "Z", "é", None]))
            for i in range(600)]
    rows += [(None, "a b c", None, "b"), (1000, None, None, "b"), (1001, "", None, "void"), (7, rows[7][1], None, rows[7][3])]
    got = mixing.mix(docs(rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (i, s, len(WORDS.findall(t or ""))) for i, t, _, s in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s]) for r in own)
        assert sum(r.taken for r in own) == math.floor(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(rows).orderBy("text")).collect()))
    assert mixing.mix(docs([])).collect() == []
    blank = mixing.mix(docs([(1, None, None, None), (2, " ", None, "a")])).collect()
    assert {(r.size, r.taken, r.target) for r in blank} == {(0, 0, 0.0)}


# ---- vector search ------------------------------------------------------------------------
def brute_topk(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in (r for r in good if r[0] % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("leaf", [4, 256])
def test_vector_search(spark, leaf, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(120)]  # copies: ties
    rows += [(600, None), (601, []), (602, [1.0, None] * 3), (603, [float("nan")] * 6), (604, [float("inf")] * 6),
             (650, [1.0, 2.0]), (651, [2.0, 1.0]), (None, rows[0][1]), (700, [3e30] * 6), (701, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, shard string, score int")
    small = [r for r in rows if r[0] != 700]
    got = {tuple(r) for r in vector_search.exact_topk(df.filter("vec_id <> 700 OR vec_id IS NULL"), F.col("vec_id") % 50 == 0,
                                                      rows_per_shard=100).collect()}
    assert got == brute_topk(small, 5)
    huge = vector_search.exact_topk(df, F.col("vec_id") % 50 == 0).collect()
    assert max(r.score for r in huge) == vector_search.LARGEST
    assert vector_search.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [2 ** 18, 2 ** 20, 2 ** 22, 2 ** 57])
def test_vector_search_of_large_values_row_by_row(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.uniform(-size, size, (400, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    # one shard: the k-th row of the first pass is the k-th row of the whole table
    got = {tuple(r) for r in vector_search.exact_topk(df, F.col("vec_id") % 5 == 0).collect()}
    cells = [[math.floor(256 * x) for x in v] for _, v in rows]
    top, want = vector_search.LARGEST, set()
    for q in range(0, 400, 5):
        scores = [(max(-top, min(top, sum(a * b for a, b in zip(cells[q], c)))), i) for i, c in enumerate(cells) if i != q]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:5]
        want |= {(q, n, i, s) for n, (s, i) in enumerate(best, 1)}
    if size < 2 ** 50:
        assert got == want
    else:  # scores beyond a long all stop at the largest one
        assert sorted((q, n, s) for q, n, _, s in got) == sorted((q, n, s) for q, n, _, s in want)


def test_tree_leaves_out_boxes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 4
    points = np.floor(256 * np.concatenate([c + rng.normal(size=(300, 8)) * 0.1 for c in centres]))
    tree = vector_search.Tree(np.arange(len(points)), points)
    bounds = tree.bounds(points[:1])
    scores = points @ points[0]
    best = sorted(zip(-scores[1:], range(1, len(points))))[:5]
    assert sorted((-s, -i) for s, i in tree.search(0, points[0], bounds[0], 5, -math.inf)) == [(s, i) for s, i in best]
    assert sum(b >= -best[-1][0] for b in bounds[0]) < len(bounds[0]) / 2


# ---- near duplicates ----------------------------------------------------------------------
def brute_components(texts, size=3, percent=90):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = WORDS.findall(w)
        sets[i] = ({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size
                   else ({tuple(w)} if w else set()))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, passage = [], " ".join(word() for _ in range(60))
    for n in (12, 40, 150):  # families of near copies around the threshold, and chains
        base = [word() for _ in range(n)]
        texts += [family(rng, base, rng.randrange(0, 2 + n // 25)) for _ in range(60)]
        chain = list(base)
        for _ in range(25):
            chain[rng.randrange(n)] = f"c{rng.randrange(10**9)}"
            texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(80)]
    texts += [" ".join(word() for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += [texts[5]] * 40 + [texts[7].upper()] * 3 + HARD_TEXTS
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 5, 80)])
def test_components_equal_brute_force(spark, docs, seed, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOT_BUCKET", 1)  # buckets of two: most members stand alone
    texts = planted(seed)
    got = ngram_join.jaccard_components(docs(list(texts.items())).repartition(5), size=size, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, size, percent)


def template_pages(n, seed=5):
    """Pages of one 20-word wording with two words of their own in it: 0.82 alike, no links."""
    rng = random.Random(seed)
    wording = [f"common{i}" for i in range(20)]
    pages = []
    for i in range(n):
        words = list(wording)
        words[7:7] = [f"own{i}", f"own{i}b"]
        pages.append(" ".join(words))
    pages[n // 2] = " ".join(wording)  # a page of the bare wording, and a near copy of one page
    return pages, rng


def test_shared_wording_equals_brute_force(spark, docs):
    pages, rng = template_pages(300)
    long = [f"l{i}" for i in range(120)]
    pages += [" ".join(long[:i] + [f"edit{i}"] + long[i + 1:]) for i in (3, 50, 51, 119)] + [pages[4]] * 5
    texts = dict(enumerate(pages))
    for size, percent in ((3, 90), (5, 80)):
        got = ngram_join.jaccard_components(docs(list(texts.items())).repartition(5), size=size, percent=percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, size, percent)


def test_work_tables_are_erased(docs, tmp_path, monkeypatch):
    names = iter(range(10_000))
    monkeypatch.setattr(common, "work_folder", lambda spark, name: f"file://{tmp_path}/{name}-{next(names)}")
    texts = planted(3)
    ngram_join.jaccard_components(docs(list(texts.items()))).collect()
    left = sorted(p.name.split("-")[0] for p in tmp_path.iterdir() if not p.name.startswith("."))
    assert left == ["classes", "edges", "links", "links", "prefixes"]


def test_join_edge_rows(docs):
    rows = [(None, "a b c d"), (5, "a b c d"), (3, "A b\tc d"), (3, "A b\tc d"), (9, None), (8, "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(rows)).collect())
    assert got == {(None, 2, None): 1, (5, 2, 3): 1, (3, 2, 3): 2, (9, 0, 9): 1, (8, 0, 8): 1}
    assert ngram_join.jaccard_components(docs([])).collect() == []


def batch_rows(rows, sizes):
    import pyarrow as pa
    at = 0
    for n in sizes:
        part = rows[at:at + n]
        at += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in part], pa.int32() if i in (1, 3) else pa.int64()) for i in (0, 1, 2, 3)],
            names=["token", "salt", "c", "pos"])


def test_pivots_across_batches():
    """Any cut into batches gives each bucket's rows with its first member; lone tokens go,
    lone members of a salted bucket stay."""
    rng = random.Random(6)
    rows = [(t := rng.randrange(12), -1 if t % 3 else rng.randrange(2), c := rng.randrange(4), c % 2) for _ in range(60)]
    rows = sorted(rows + [(50, -1, 1, 0), (51, 2, 1, 0)], key=lambda r: (r[0], r[1], r[3], r[2]))
    groups = defaultdict(list)
    for r in rows:
        if r[2:] not in groups[r[:2]]:
            groups[r[:2]].append(r[2:])
    want = sorted((key[0], *m, *members[0]) for key, members in groups.items() for m in members
                  if len(members) > 1 or key[1] >= 0)
    for _ in range(30):
        sizes, left = [], len(rows)
        while left:
            sizes.append(rng.randrange(0, min(left, 9) + 1))
            left -= sizes[-1]
        got = [tuple(r.values()) for b in ngram_join._with_pivots(batch_rows(rows, sizes)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_prefix_lemma():
    """Any two sets above the threshold share a token in the prefixes, under every order."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 60)
        base = [rng.randrange(10**9) for _ in range(n)]
        other = base[:n - rng.randrange(0, 1 + n // 10)] + [rng.randrange(10**9) for _ in range(rng.randrange(0, 1 + n // 10))]
        x, y = sorted((set(base), set(other)), key=len)
        if 100 * len(x & y) < 90 * len(x | y):
            continue
        order = lambda t: hashlib.md5(str(t).encode()).digest()
        first = sorted(x, key=order)[:ngram_join.index_length(len(x), 90)]
        assert set(first) & set(sorted(y, key=order)[:ngram_join.probe_length(len(y), 90)])


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(1, 9), (9, 4), (7, 7), (3, None)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {1: 1, 9: 1, 4: 1} | {i: 500 for i in range(500, 540)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- pipeline -----------------------------------------------------------------------------
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lang, quality, near, mix, bpe = (f for _, f in corpus_pipeline.STAGES)
    one = lang(spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert len(kept) >= 0.98 * len(texts)
    two = quality(spark, one, SF)
    ids = {r.doc_id for r in two.collect()}
    assert ids <= kept
    junk = {i for i in kept if i in labels and labels[i].quality == 0}
    clean = {i for i in kept if i in labels and labels[i].quality == 1 and len(texts[i].split()) >= 10}
    assert len(junk & ids) <= 0.05 * len(junk) and len(clean - ids) <= 0.02 * len(clean)
    three = near(spark, two, SF)
    groups = brute_components({i: texts[i] for i in ids}, 5, 80)
    left = sorted(r.doc_id for r in three.collect())
    assert left == sorted(i for i in ids if groups[i][1] == i)
    four = mix(spark, three, SF)
    assert four.columns == docs.columns
    copies = Counter(r.doc_id for r in four.collect())
    taken = {r.doc_id: r for r in mixing.mix(three.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()}
    assert copies == {int(i): -(-r.taken // r.size) for i, r in taken.items() if r.taken}
    last = bpe(spark, four, SF).collect()
    assert Counter(r.doc_id for r in last) == copies and all(r.restored and r.n_tokens > 0 for r in last)


def pipeline_rows(docs, clash):
    rows = [(i, t, "aa" if i % 2 else None, None) for i, t in enumerate(HARD_TEXTS)]
    rows += [(None, "letters of a longer kind " * 3, "bb", "s")] * 3 + [(4, "twice the same id here", "bb", None)] * 2
    df = docs(rows, clash=False)
    for name in ("a.b", "_copies", "_name", "name", "row", "text.x", "copies", "rejected", "kept", "x`y") if clash else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_pipeline_odd_rows(spark, docs):
    """Null, blank, long and repeated rows, columns of any name, no rows at all."""
    plain, clashing = pipeline_rows(docs, clash=False), pipeline_rows(docs, clash=True)
    key = lambda r: (str(r.doc_id), str(getattr(r, "text", r.lang)))
    for name, stage in corpus_pipeline.STAGES:
        want, out = stage(spark, plain, SF), stage(spark, clashing, SF)
        got = out.collect()
        assert sorted(map(key, got)) == sorted(map(key, want.collect()))
        if name != "bpe":
            assert want.columns == plain.columns and out.columns == clashing.columns
            assert {r["a.b"] for r in got} <= {"clash"}
        assert stage(spark, plain.limit(0), SF).collect() == []


def test_near_duplicate_stage_keeps_unrelated_texts_of_one_id(spark, docs):
    words = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " end"), (3, words("b")), (0, words("c")), (0, words("c")),
            (None, words("d")), (None, words("d")), (None, words("e")), (5, words("e")), (-7, words("f")), (6, words("f")),
            (8, None), (8, None), (8, ""), (9, "short"), (10, "short"), (None, None)]
    table = docs(rows, clash=False).withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id()))
    first = corpus_pipeline.near_duplicate_stage(spark, table, SF).collect()
    got = Counter((r.doc_id, r.text) for r in first)
    assert got == Counter([(1, words("a")), (1, words("b")), (0, words("c")), (None, words("d")), (5, words("e")),
                           (-7, words("f")), (8, None if (8, None) in got else ""), (9, "short"), (None, None)])
    again = corpus_pipeline.near_duplicate_stage(spark, table.orderBy(F.desc("text")), SF).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, first))


def test_mixing_stage_loses_no_row_of_a_shared_id(spark, docs):
    rows = [(1, "one two three", None, "s"), (1, "four five six seven", None, "s"), (2, "w " * 40, None, "t"),
            (None, "no id here", None, "s"), (3, None, None, "s"), (4, " ", None, None)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs(rows), SF).collect())
    taken = {r.doc_id: r for r in mixing.mix(docs(rows).withColumn("doc_id", F.coalesce(
        F.col("doc_id").cast("string"), F.lit("text " + hashlib.md5(b"no id here").hexdigest())))).collect()}
    assert taken["1"].taken > 0 and got[1, "one two three"] == got[1, "four five six seven"] >= 1
    assert (3, None) not in got and (4, " ") not in got


def test_shingles_hold_a_part_of_the_strings(monkeypatch):
    import pyarrow as pa
    seen, whole = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "PART", 2000)
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda texts, *rest: seen.append(len(texts)) or whole(texts, *rest))
    texts = [None, "", *(f"row {i} has some words of its own {i * i}" for i in range(500))]
    got = list(ngram_join._sets_of(pa.array(texts), 3))
    want = whole(texts, ngram_join._Words(), 3)
    assert max(seen) < 100 and len(got) == len(want)
    assert all(a.tolist() == b.tolist() for a, b in zip(got, want))
