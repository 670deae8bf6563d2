"""Tables in versions, exports of any depth, personal data whose digits hold."""

import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgrain.operators import privacy, versions
from claimgrain.plans import registry
from claimgrain.sources import exports

registry.load_all()


# ---- versions -----------------------------------------------------------------------------------

def table(spark, n=500):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("old").alias("v"))


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, v string, n int")


def content(df):
    return {r.key: r.v for r in df.collect()}


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    base = {f"k{i}": "old" for i in range(500)}
    assert versions.create(table(spark), path, "key", 32) == 0
    pinned = versions.read(spark, path)
    with pytest.raises(ValueError, match="already"):
        versions.create(table(spark, 1), path, "key", 32)
    first = versions.change(spark, path, changes(spark, ("k7", "a", 1), ("k7", "b", 2), ("new", "c", 1)), "key", "n", 32)
    assert first == 1 and versions.versions(spark, path) == [0, 1]
    assert content(pinned) == base                       # a reader that was there before
    assert content(versions.read(spark, path)) == base | {"k7": "b", "new": "c"}
    assert content(versions.read(spark, path, 0)) == base
    written = [d for d in os.listdir(f"{path}/rows/made=1") if d.startswith("bucket")]
    assert 1 <= len(written) <= 2                        # only the buckets that changed
    assert versions.change(spark, path, changes(spark, ("x", "y", 1)).limit(0), "key", "n", 32) == 1
    assert versions.change(spark, path, changes(spark, *[("hot", str(i), i) for i in range(400)]), "key", "n", 32) == 2
    assert content(versions.read(spark, path)) == base | {"k7": "b", "new": "c", "hot": "399"}
    assert versions.forget(spark, path, 2) == [0, 1]
    assert content(versions.read(spark, path)) == base | {"k7": "b", "new": "c", "hot": "399"}


def test_a_change_that_dies_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(table(spark, 50), path, "key", 4)
    versions._write(table(spark, 50).withColumn("v", F.lit("half")), path, 1, "key", 4)  # rows, but no version
    assert versions.versions(spark, path) == [0]
    assert content(versions.read(spark, path)) == {f"k{i}": "old" for i in range(50)}
    assert versions.change(spark, path, changes(spark, ("k1", "new", 1)), "key", "n", 4) == 1
    assert content(versions.read(spark, path)) == {f"k{i}": "old" for i in range(50)} | {"k1": "new"}
    with pytest.raises(Exception):  # the slower of two writers
        versions._commit(spark, path, 1, {0: 1})


def test_versions_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(table(spark, 0), path, "key", 4)
    assert versions.read(spark, path).collect() == [] and versions.read(spark, path).columns == ["key", "v"]
    versions.change(spark, path, changes(spark, ("a", "b", 1)), "key", "n", 4)
    assert content(versions.read(spark, path)) == {"a": "b"}


# ---- exports of any depth -------------------------------------------------------------------------

def plain_lessons(stem, value):
    out = []

    def walk(node, path, course):
        if not isinstance(node, dict):
            return
        course = node.get("course_name") or course
        for name in exports.CHILD_LISTS:
            if isinstance(node.get(name), list):
                for i, kid in enumerate(node[name]):
                    walk(kid, [*path, i], course)
                return
        content = node.get("content") if node.get("content") is not None else node.get("text") or ""
        if content:
            out.append((stem, ".".join(map(str, path)), f"{course}: {node.get('title') or 'Lesson'}", content))

    try:
        root = json.loads(value)
    except (TypeError, ValueError):
        return out
    for i, node in enumerate(root if isinstance(root, list) else [root]):
        walk(node, [i], stem)
    return out


def random_export(rng, depth):
    if depth == 0 or rng.random() < .2:
        node = {k: v for k, v in (("title", "T"), ("content", f"c{rng.randrange(99)}"), ("text", "t")) if rng.random() < .6}
    else:
        node = {rng.choice(exports.CHILD_LISTS): [random_export(rng, depth - 1) for _ in range(rng.randrange(3))]}
    if rng.random() < .3:
        node["course_name"] = f"course {rng.randrange(9)}"
    return node


def test_nested_lessons(spark):
    rng = random.Random(7)
    six = {"modules": [{"sections": [{"units": [{"children": [{"lessons": [{"title": "Deep", "content": "found"}]}]}]}]}]}
    values = [json.dumps(six), json.dumps([random_export(rng, 6) for _ in range(3)]), "not json", None, "[]", "7", '["x", null, {"text": "here"}]',
              json.dumps({"modules": {"no": "list"}, "content": "own"}), json.dumps({"modules": [], "content": "none"}), json.dumps({"content": "  "})]
    values += [json.dumps(random_export(rng, rng.randrange(8))) for _ in range(60)]
    values += [json.dumps({"lessons": [{"text": f"l{i}"} for i in range(3000)]})]  # a third of all lessons and more
    files = spark.createDataFrame([(f"f{i}", v, "clash") for i, v in enumerate(values)], "stem string, value string, path string")
    got = Counter(map(tuple, exports.nested_lessons(files).collect()))
    want = Counter(r for i, v in enumerate(values) for r in plain_lessons(f"f{i}", v) if r[3].strip())
    assert Counter({k: n for k, n in got.items() if k[3]}) == want
    assert ("f0", "0.0.0.0.0.0", "f0: Deep", "found") in got
    assert exports.nested_lessons(files.limit(0)).collect() == []


def test_nested_lessons_of_three_levels_are_course_lessons(spark):
    sf = "/root/testdata/sf0.001"
    flat = registry.QUERIES["course_lessons"](spark, sf).select("stem", "source_name", "content")
    deep = registry.QUERIES["course_lessons_nested"](spark, sf).select("stem", "source_name", "content")
    assert Counter(map(tuple, flat.collect())) == Counter(map(tuple, deep.collect()))


# ---- checked personal data --------------------------------------------------------------------------

def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0


def account_holds(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


KINDS = {
    "card": (r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", lambda f: luhn(re.sub("[ -]", "", f))),
    "ipv4": (r"(?<![0-9A-Za-z])(?<![0-9][.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9A-Za-z]|[.][0-9])",
             lambda f: all(int(o) <= 255 and (o == "0" or o[0] != "0") for o in f.split("."))),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])", account_holds)}


def plain_checked(text):
    counts = []
    for kind, (pattern, holds) in KINDS.items():
        finds = [f for f in re.findall(pattern, text or "") if holds(f)]
        counts.append(len(finds))
        if finds:
            text = re.sub(pattern, lambda m: f"[{kind}]" if holds(m.group()) else m.group(), text)
    return (*counts, text)


def test_checked_kinds(spark):
    texts = ["pay 4111 1111 1111 1111 now", "4111-1111-1111-1112", "x4111111111111111", "0" * 13, "4111111111111111" * 3,
             "host 192.168.0.1, 256.1.1.1, 1.2.3.4.5, 01.2.3.4, 10.0.0.255.", "v1.2.3.4 1.2.3.4 1.2.3.4",
             "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606",
             None, "", "a" * 50_000, "4111111111111111 " * 2000, "é4111111111111111é", "1.2.3.4 11.2.3.45"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice(["4111111111111111", "1.2.3.4", "999.1.1.1", "DE89370400440532013000", "DE89370400440532013001", "12", "-", "AB12"])
                       for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, kept string")
    got = {r.id: (r.n_card, r.n_ipv4, r.n_account, r.masked) for r in privacy.checked_pii(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_checked(t), t[:60] if t else t
    assert privacy.checked_pii(df.limit(0)).collect() == []


def test_checked_kinds_over_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["checked_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_card, r.n_ipv4, r.n_account, r.masked) == plain_checked(texts[r.doc_id])


def test_a_version_makes_its_rows_once(spark, tmp_path):
    path, made = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        made.add(1)
        return value

    counted = counted.asNondeterministic()
    versions.create(table(spark, 60).withColumn("v", counted("v")), path, "key", 4)
    assert made.value == 60
    versions.change(spark, path, changes(spark, *[(f"k{i}", "b", 1) for i in range(9)]).withColumn("v", counted("v")),
                    "key", "n", 4)
    assert made.value == 69
    assert Counter(content(versions.read(spark, path)).values()) == {"old": 51, "b": 9}
