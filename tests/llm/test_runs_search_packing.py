"""Periodic runs, ranked lexical search and best-fit packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrain.llm import lexical_search, packing, periodic_runs, queries
from tests.llm.conftest import HARD_TEXTS

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- periodic runs ------------------------------------------------------------------------
def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs(spark, docs):
    rng = random.Random(2)
    texts = list(HARD_TEXTS)
    for _ in range(400):
        words = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < .7:
            a, p = rng.randrange(len(words)), rng.randint(1, 17)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += ["x y z x y z x y z x y z " * 40, ("p q " * 9 + "stop ") * 8, "k " * 5, "k " * 6]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a a"), (3, "b " * 9)]
    got = periodic_runs.periodic_runs(docs(rows)).collect()
    want = Counter()
    for i, t in rows:
        words = WORDS.findall(t or "")
        runs = brute_runs(words)
        want[i, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert periodic_runs.periodic_runs(docs([])).collect() == []


def test_runs_of_a_long_text(spark, docs):
    rng = random.Random(4)
    unit = [f"w{rng.randrange(9000)}" for _ in range(20_000)]
    words = [f"h{i}" for i in range(500)] + unit * 4 + ["end"] + ["la"] * 30_000
    row = periodic_runs.periodic_runs(docs([(1, " ".join(words))])).first()
    assert [tuple(r) for r in row.runs] == [(500, 80_000, 20_000), (80_501, 30_000, 1)]
    assert row.collapsed == " ".join(words[:500] + unit + ["end", "la"])


def test_runs_query(spark):
    seen = 0
    got = {r.doc_id: r for r in queries.op11(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(table)
    for d in table:
        words = WORDS.findall(d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:  # plain search is quadratic
            continue
        runs, r = brute_runs(words), got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        seen += len(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert seen > 5


# ---- ranked lexical search ----------------------------------------------------------------
def terms_of(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    own = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    total, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in own:
            m = 100 - 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("group, mined", [(256, 1024), (3, 4)])
def test_search(spark, docs, monkeypatch, group, mined):
    monkeypatch.setattr(lexical_search, "GROUP_ITEMS", group)
    monkeypatch.setattr(lexical_search, "MINED_NODES", mined)
    monkeypatch.setattr(lexical_search, "SLICE_CELLS", 2000)
    rng = random.Random(8)
    words = [f"t{i}" for i in range(40)] + ["Éa", "über", "日本", "x-y"]
    text = lambda n: " ".join(rng.choices(words, [60 // (i + 1) + 1 for i in range(len(words))], k=n))
    rows = [(i, text(rng.randrange(60))) for i in range(300)] + list(enumerate(HARD_TEXTS, 300))
    rows += [(400 + i, rows[5][1]) for i in range(120)] + [(None, text(9)), (7, text(5)), (600, "t1 " * 5000)]
    shared = [text(12) for _ in range(4)]
    items = [(i, rng.choice(shared) + " " + text(6)) for i in range(20)]
    items += [(30, None), (31, "..."), (32, "T1 t1 -t1"), (33, "nowhere"), (None, "t2 t3"), (4, "t39")]
    asked = spark.createDataFrame([(*i, "clash", 1) for i in items], "item_id long, text string, term string, score int")
    got = lexical_search.ranked_search(docs(rows), asked, k=15)
    assert Counter(map(tuple, got.collect())) == brute_search(rows, items, 15)
    assert lexical_search.ranked_search(docs([]), asked).collect() == []
    assert lexical_search.ranked_search(docs(rows), asked.limit(0)).collect() == []
    assert lexical_search.ranked_search(docs(rows), asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", 5)
    rows = [(i, f"a b{i % 3} c{i % 5}") for i in range(40)]
    items = [(i, f"a b{i} c{i} c{i + 1}") for i in range(5)]
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = lexical_search.ranked_search(docs(rows), asked, k=7).collect()
    assert Counter(map(tuple, got)) == brute_search(rows, items, 7)


def test_shared_sums_are_the_plain_sums():
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(50)]
    plan = lexical_search.share(list(range(50)), terms, 60)
    assert plan.layers and plan.additions() < sum(max(0, len(t) - 1) for t in terms)
    term, row = np.repeat(np.arange(60), 9), np.tile(np.arange(9), 60)
    value = rng.integers(0, 10 ** 9, 540)
    got = dict(lexical_search.accumulate(plan, term, row, value, 9))
    table = value.reshape(60, 9)
    for i, own in enumerate(terms):
        assert (i in got) == bool(len(own))
        if len(own):
            assert (got[i] == table[own].sum(axis=0)).all()


# ---- packing ------------------------------------------------------------------------------
def check_packing(rows, limit=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    return len(by)


def best_fit_decreasing(lengths, limit=1024):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if fit is None:
            gaps.append(limit - x)
        else:
            gaps[fit] -= x
    return len(gaps)


def shapes():
    rng = random.Random(6)
    yield "uniform", [rng.randint(1, 1024) for _ in range(600)]
    yield "one length is a third", [300] * 300 + [rng.randint(1, 700) for _ in range(600)]
    yield "short", [rng.randint(1, 60) for _ in range(900)]
    yield "few sizes", [rng.choice([1, 2, 341, 511, 512, 513, 1023, 1024]) for _ in range(500)]
    yield "one", [7]


@pytest.mark.parametrize("name, lengths", list(shapes()))
def test_packing(spark, name, lengths):
    pieces = spark.createDataFrame([(n, f"p{i % 7}", "clash") for i, n in enumerate(lengths)],
                                   "length long, id string, gap string")
    rows = packing.pack(pieces).collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    assert Counter((r.id, r.gap) for r in rows) == Counter((f"p{i % 7}", "clash") for i in range(len(lengths)))
    used = check_packing(rows)
    assert used <= best_fit_decreasing(lengths) * 1.01 + 2


def test_packing_of_nothing_and_of_wrong_lengths(spark):
    none = spark.createDataFrame([], "length long, x int")
    assert packing.pack(none).collect() == []
    assert packing.pack(none).columns == ["length", "x", "sequence_id", "offset"]
    for bad in (0, 1025, None):
        with pytest.raises(Exception, match="a piece is empty or longer"):
            packing.pack(spark.createDataFrame([(bad,)], "length long")).collect()


def test_leftovers_of_ranges_are_matched_by_rank():
    crossed, opened, used = packing.match_ranges([(0, 2, 3), (1, 4, 1), (2, 0, 0), (3, 1, 0), (5, 1, 2)])
    assert opened == [(0, 0, 0), (1, 3, 2), (5, 0, 3)]
    assert crossed == [(1, 0, 3, 0, 0), (3, 0, 1, 1, 0)]
    assert used == {0: 3, 1: 1}


def test_token_pieces(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation()
    plain.no_padding()
    texts = HARD_TEXTS + ["<|endoftext|> in <|endoftext|>", "word " * 1023, "word " * 1024, "q" * 9000, " " * 1_200_000, "Zoë " * 2500]
    rows = list(enumerate(texts)) + [(None, "no key"), (2, "again")]
    got = defaultdict(list)
    made = packing.token_pieces(docs(rows), queries.byte_bpe(), with_ids=True)
    for r in made.collect():
        got[r.doc_id].append(r)
    assert set(got) == {i for i, _ in rows}
    for i, t in enumerate(texts):
        if i == 2:
            continue
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        own, at = sorted(got[i], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            packed = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, bytes(r.ids)) == (at, zlib.crc32(packed), packed)
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
    packed = packing.pack(made)
    used = check_packing(packed.collect())
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and all(len(r.ids) == 4 * r.length for r in whole)
    assert sum(r.length for r in whole) == sum(r.length for own in got.values() for r in own)
    assert packing.token_pieces(docs([]), queries.byte_bpe()).collect() == []


def test_packing_query(spark):
    rows = queries.op13(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bound = math.ceil(sum(r.length for r in rows) / 1024)
    assert check_packing(rows) <= bound * 1.02 + 2
    again = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in queries.op13(spark, SF).collect())
    assert again == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
