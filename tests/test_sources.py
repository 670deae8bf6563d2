import json
import os

from pyspark.sql import functions as F

from claimgrain.operators import graph, ingest
from claimgrain.sources import adapters, exports, files


def write(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_document_scan(spark, tmp_path):
    d = str(tmp_path)
    write(d, "b.txt", "beta")
    write(d, "A.MD", b"bad \xff byte")
    write(d, "note.v2.txt", "stem keeps inner dots")
    write(d, "blank.txt", " \n ")
    write(d, ".hidden.txt", "hidden")
    write(d, "x.docx", "no")
    docs = files.document_files(files.whole_files(spark, d)).collect()
    got = {r.source_name: r.raw_content for r in docs}
    assert got == {"b": "beta", "A": "bad � byte", "note.v2": "stem keeps inner dots"}
    assert {r.evidence_tier for r in docs} == {2} and all(r.source_url is None for r in docs)


def test_id_list(spark, tmp_path):
    path = write(str(tmp_path), "urls.txt", "# head\n\n https://a.org/x#frag \nhttps://b.org  # My label\n   # c\n")
    got = [(r.value, r.label) for r in files.read_id_list(spark, path).collect()]
    assert got == [("https://a.org/x#frag", None), ("https://b.org", "My label")]


def test_source_line_round_trip(spark):
    df = spark.createDataFrame([("u1", "L"), ("u2", None)], "url string, label string")
    lines = df.select(ingest.source_line(F.col("url"), F.col("label")).alias("value"))
    assert [(r.value, r.label) for r in files.id_list(lines).collect()] == [("u1", "L"), ("u2", None)]


def test_landing(spark, tmp_path):
    d = str(tmp_path)
    write(d, "ok.PDF", "1234")
    write(d, "big.txt", "12345678901")
    write(d, "bad.exe", "1")
    got = {r.name: r.reason for r in files.validate_landing(files.landing_files(spark, d), 10).collect()}
    assert got == {"ok.PDF": None, "big.txt": "File exceeds 50 MB limit", "bad.exe": "Unsupported extension '.exe'"}


def export(spark, *values):
    return spark.createDataFrame([(f"s{i}", v if isinstance(v, str) else json.dumps(v))
                                  for i, v in enumerate(values)], "stem string, value string")


def test_thread_export(spark):
    thread = {"title": "T", "posts": [{"author": "a", "content": "hi"}, {"content": "yo"}, {"author": "b", "content": ""}]}
    got = {(r.source_name, r.position): r.content for r in exports.thread_export(
        export(spark, [thread, {"posts": []}], thread, "broken{")).collect()}
    assert got == {("s0", 0): "Thread: T\n\n[a]: hi\n\n[Unknown]: yo", ("s0", 1): "Thread: Forum Thread",
                   ("s1", 0): "Thread: T\n\n[a]: hi\n\n[Unknown]: yo"}


def test_community_export(spark):
    post = {"content": "p", "replies": [{"author": "a", "content": "r"}, {"content": "s"}, {"content": ""}]}
    want = "p\n\n[Reply from a]: r\n\n[Reply from member]: s"
    got = exports.community_export(export(spark, [post], {"posts": [post, {"content": ""}]}, post)).collect()
    assert sorted((r.source_name, r.content) for r in got) == [(f"Skool Community: s{i}", want) for i in range(3)]


def test_course_levels_fall_back(spark):
    lesson = {"title": "L", "content": "c"}
    got = exports.course_lessons(export(
        spark, {"course_name": "C", "modules": [{"lessons": [lesson, {"text": "t"}, {"title": "none"}]}]},
        {"course_name": "C", "lessons": [lesson]}, [{"modules": [lesson]}], {"content": "bare"})).collect()
    assert sorted((r.stem, r.source_name, r.content) for r in got) == [
        ("s0", "C: L", "c"), ("s0", "C: Lesson", "t"), ("s1", "C: L", "c"), ("s2", "s2: L", "c"),
        ("s3", "s3: Lesson", "bare")]


def test_course_pages(spark):
    got = exports.course_pages(export(spark, "<h1>A</h1><nav>x</nav><p>b</p>", "<script>1</script>")).collect()
    assert [(r.source_name, r.content) for r in got] == [("s0", "A b")]


def test_abstracts(spark):
    rows = [("1", "T", "A", list("abcdefg"), "J"), ("2", "", "only", [], None), ("3", "", "", ["x"], "J"), (None, "t", None, None, "")]
    df = spark.createDataFrame(rows, "pmid string, title string, abstract string, authors array<string>, journal string")
    got = {r.source_name: (r.source_url, r.content) for r in exports.abstract_documents(df).collect()}
    assert got["PubMed:1"] == ("https://pubmed.ncbi.nlm.nih.gov/1/",
                               "Title: T\n\nAbstract: A\n\nAuthors: a, b, c, d, e\nJournal: J")
    assert got["PubMed:2"][1] == "Title: \n\nAbstract: only" and "PubMed:3" not in got
    assert got["PubMed:"][0] is None


def posts(spark, n, thread=1):
    rows = [(thread, i, f"u{i}", "" if i == 3 else f"text {i}\n\nmore {i}", "Big") for i in range(n)]
    return spark.createDataFrame(rows, "thread_id int, position int, author string, content string, title string")


def test_threads_stay_whole(spark):
    rows = exports.thread_documents(posts(spark, 2500)).collect()
    assert len(rows) == 1 and "[u3]" not in rows[0].content
    assert rows[0].content.startswith("Thread: Big\n\n[u0]: text 0\n\nmore 0\n\n[u1]")
    assert rows[0].content.endswith("[u2499]: text 2499\n\nmore 2499")


def test_chunks_of_long_threads_equal_brute_force(spark):
    df = posts(spark, 2500).unionByName(posts(spark, 5, thread=2)).unionByName(posts(spark, 1001, thread=3))
    got = {(r.thread_id, r.chunk_index): r.content for r in exports.thread_chunks(df.repartition(7)).collect()}
    want = {}
    for r in exports.thread_documents(df).collect():
        paragraphs = r.content.split("\n\n")
        want |= {(r.thread_id, i // 4): "\n\n".join(paragraphs[i:i + 4]) for i in range(0, len(paragraphs), 4)}
    assert got == want and len(got) == exports.thread_chunks(df).count()


def test_long_transcripts_stay_whole_and_ids_unique(spark):
    df = posts(spark, 2500).withColumn("content", F.expr("array_join(transform(sequence(0, position % 5), i -> concat('w', position, '_', i)), ' ')"))
    df = df.unionByName(posts(spark, 3, thread=2)).unionByName(posts(spark, 1, thread=5).withColumn("content", F.lit(" ")))
    docs = exports.transcript_documents(df).collect()
    assert len(docs) == 3 and len({r.source_url for r in docs}) == 3
    rows = exports.transcript_chunks(df.repartition(5)).collect()
    got = {(r.thread_id, r.chunk_index): r.content for r in rows}
    assert len(got) == len(rows)
    want = {}
    for r in docs:
        w, start = r.content.split(), 0
        while w:
            want[r.thread_id, start // 462] = " ".join(w[start:start + 512])
            if start + 512 >= len(w):
                break
            start += 462
    assert got == want
    ids_of = ingest.ingest(exports.transcript_documents(df).withColumnRenamed("content", "raw_content").withColumn(
        "source_type", F.lit("youtube")).withColumn("acquired_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    assert ids_of.count() == ids_of.select("chunk_id").distinct().count() == len(want)


def test_transcript_order(spark):
    df = posts(spark, 12).withColumn("content", F.concat(F.lit("w"), F.col("position")))
    row = exports.transcript_documents(df.orderBy(F.desc("position"))).collect()[0]
    assert row.content == " ".join(f"w{i}" for i in range(12)) and row.source_name == "YouTube:1"


def test_chunk_table_round_trip(spark, tmp_path):
    chunks = adapters.chunks(spark, "/root/testdata/sf0.001").withColumnRenamed("evidence_tier", "evidence_tier_default") \
        .withColumn("jurisdiction", F.lit(None).cast("string"))
    path = str(tmp_path / "chunks")
    files.write_chunks(chunks, path)
    back = spark.read.parquet(path)
    key = ["chunk_id", "source_type", "content_hash", "content", "evidence_tier", "acquired_at", "published_at"]
    want = sorted(map(str, chunks.withColumnRenamed("evidence_tier_default", "evidence_tier").select(key).collect()))
    assert sorted(map(str, files.read_chunks(spark, path).select(key).collect())) == want
    files.chunk_json(chunks).coalesce(3).write.text(str(tmp_path / "lines"))  # many rows per file
    write(str(tmp_path / "lines"), "bad.json", '{"chunk_id": "x"}\n\nnot json\n{"chunk_id": "y", "document_id": 3\n')
    good, bad = files.read_chunk_lines(spark, str(tmp_path / "lines"))
    assert sorted(map(str, good.select(key).collect())) == want
    assert sorted(r.reason for r in bad.collect()) == ["missing: document_id, content", "not a JSON object", "not a JSON object"]
    as_json = str(tmp_path / "json_table")
    files.write_chunks(chunks, as_json, "json")
    assert sorted(map(str, files.read_chunks(spark, as_json, "json").select(key).collect())) == want
    key = ["chunk_id", "source_type", "content_hash", "content"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, chunks.select(key).collect()))
    assert back.filter("source_type = 'forum'").count() == chunks.filter("source_type = 'forum'").count()

    folder = str(tmp_path / "json")
    files.chunk_json(chunks).limit(20).write.text(folder)
    lines = spark.read.text(folder)
    assert "metadata" in json.loads(lines.first().value)
    loaded = files.load_chunks(lines.unionByName(spark.createDataFrame([('{"chunk_id": "x"',), ("{}",)], "value string")))
    assert loaded.count() == 20


def test_chunk_json_files_and_triple_files(spark, tmp_path):
    d = str(tmp_path / "n")
    os.mkdir(d)
    write(d, "a.json", json.dumps({"chunk_id": "a", "document_id": "d", "content": "x", "published_at": ""}, indent=2))
    write(d, "b.json", "{broken")
    good, bad = files.read_chunk_documents(spark, d)
    assert [r.reason for r in bad.collect()] == ["not a JSON object"]
    row = good.collect()
    assert len(row) == 1 and row[0].evidence_tier == 3 and row[0].published_at is None
    assert str(row[0].acquired_at) == "2024-01-01 00:00:00" and row[0].source_type == "unknown"

    t = str(tmp_path / "t")
    os.mkdir(t)
    edge = {"subject": "a", "relation": "TREATS", "object": "b"}
    write(t, "1_triples.json", json.dumps([edge, {**edge, "relation": "INHIBITS"}]))
    write(t, "2_triples.json", json.dumps({**edge, "object": "c"}))
    write(t, "3_triples.json", "[{")
    edges = graph.build_edges(files.load_triples(files.whole_files(spark, t)))
    assert sorted((e.src, e.dst, e.relation) for e in edges.collect()) == [("a", "b", "INHIBITS"), ("a", "c", "TREATS")]
    out = str(tmp_path / "edges")
    files.write_edges(edges, out)
    assert {json.loads(r.value)["target"] for r in spark.read.text(out).collect()} == {"b", "c"}
