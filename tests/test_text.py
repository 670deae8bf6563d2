import unicodedata

import pytest
from pyspark.sql import functions as F

from claimgrain.functions import chunking, text


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "a string")
    return df.select(fn(F.col("a")).alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("raw, want", [
    ("a  b\t\tc", "a b c"),
    ("a\u00a0\u200b\ufeffb", "a b"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("  a\n ", "a"),
    ("\ufb01ne \uff21\uff22", "fine AB"),
    ("e\u0301t\u00e9", "\u00e9t\u00e9"),
    ("a\rb", "a\rb"),
    ("", ""), (None, ""),
])
def test_normalize_whitespace(spark, raw, want):
    assert one(spark, raw, text.normalize_whitespace) == want


def test_stable_characters_are_untouched_by_nfkc(spark):
    chars = "".join(c for c in map(chr, range(1, 0x2100)) if one_stable(c))
    assert len(chars) > 300
    assert unicodedata.normalize("NFKC", chars) == chars


def one_stable(c):
    import re
    pattern = text.NFKC_STABLE.replace("*+$", "*$")
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m.group(1).rjust(4, "0"), pattern)
    return re.match(pattern, c) is not None and c != "\n"


@pytest.mark.parametrize("raw, want", [
    ("keep\nAccept all cookies now\nend", "keep\nend"),
    ("x privacy policy here\ny", "x y"),
    ("Terms of Service apply", ""),
    ("see terms and conditions below\nz", "see z"),
    ("Cookie settings: none\nz", "z"),
    ("Subscribe to our newsletter!\nz", "z"),
    ("foo. All Rights Reserved.", "foo."),
    ("Copyright 2023 Example\nz", "z"),
    ("copyright 23 stays", "copyright 23 stays"),
    ("Skip to main content z\nb", "b"),
    ("Menu  \nb", "b"),
    ("menus stay", "menus stay"),
    ("a\n  Share this page\nb", "a\nb"),
    ("we share this view", "we share this view"),
    ("acce\u017f\u017f \u017fkip to content z\nb", None),
])
def test_remove_boilerplate(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string").withColumn("a", text.drop_boilerplate(F.col("a")))
    got = df.select(text.normalize_whitespace(F.col("a")).alias("v")).collect()[0]["v"]
    if want is None:
        assert got == "access b"
    else:
        assert got == want


@pytest.mark.parametrize("html, want", [
    ("<p>a</p><p>b</p>", "a b"),
    ("<script>var x='<p>';</script>t", "t"),
    ("<SCRIPT type='x'>a</SCRIPT >t", "t"),
    ("<style>p{}</style><nav>menu</nav>body<footer>f</footer>", "body"),
    ("<header>h</header>a<headers>b", "a b"),
    ("a<!-- <p>no</p> -->b", "a b"),
    ("1 < 2 &amp;&lt;b&gt;", "1 < 2 &<b>"),
    ("&amp;lt;", "&lt;"),
    ("&eacute;&#8211;&#x41; &copy;", "\u00e9\u2013A \u00a9"),
    ("<p>\n  spaced \n</p>", "spaced"),
    ("kept<script>never closed", "kept"),
    ("", ""), (None, ""),
])
def test_clean_html(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert text.clean_html(df, "html", "t").collect()[0]["t"] == want


def test_detect_language(spark):
    assert one(spark, "short", text.detect_language) is None
    assert one(spark, "long enough to be called English", text.detect_language) == "en"


@pytest.mark.parametrize("raw, want", [
    ("<nav>a<nav>b</nav>menu-tail</nav>left", "left"), ("<div><nav>x</div><p>kept?</p>", "kept?"),
    ("<header-bar>in</header-bar> out", "in out"), ('<p title="a>b">z</p>', "z"),
    ("<p title='a>b'>z<nav title='>'>n</nav></p>y", "z y"), ("<nav/>a<b>c</b>", "a c"),
    ("<script>if (a<b) '<nav>'</script>x", "x"), ("a &amp;lt; b<nav>n<nav>", "a &lt; b"),
    ("</nav>a<footer>f", "a"), ("one<br>two<!-- c -->three", "one two three"), ("", ""),
])
def test_html_that_nests(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert text.clean_html(df, "a", "v").collect()[0]["v"] == want


def test_tree_and_patterns_agree_on_well_paired_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    assert pages.filter(text.needs_tree(F.col("html"))).count() == 0
    for r in text.clean_html(pages, "html", "v").collect():
        assert r.v == text._Page.text(r.html)


@pytest.mark.parametrize("raw", ["a b", " a\u2003b\x1cc\u3000d ", "\u00e9 b\u1680c", "", " \n "])
def test_words_like_python(spark, raw):
    assert one(spark, raw, text.words) == raw.split()


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (512, 1), (513, 2), (974, 2), (975, 3)])
def test_window_counts(spark, n, want):
    raw = " ".join(f"w{i}" for i in range(n))
    split = spark.createDataFrame([(raw,)], "a string").select(text.words(F.col("a")).alias("w"))
    chunks = split.select(chunking.token_windows(F.col("w")).alias("c")).collect()[0]["c"]
    assert len(chunks) == want
    # overlaps dropped, the chunks give the text back
    rebuilt = [w for i, c in enumerate(chunks) for w in c.split()[50 if i else 0:]]
    assert rebuilt == raw.split()


def test_window_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        chunking.token_windows(F.lit(None), 10, 10)


def test_paragraph_groups(spark):
    raw = "p1\n\np2\n \np3\n\n\n\np4\nline"
    got = one(spark, raw, lambda c: chunking.paragraph_groups(chunking.paragraphs(c), 3))
    assert got == ["p1\n\np2\n\np3", "p4\nline"]
    assert one(spark, " \n\n ", lambda c: chunking.paragraph_groups(chunking.paragraphs(c), 3)) == []


def test_sentence_groups(spark):
    raw = "See Dr. Who now. It was vs. them! Was it? " + "Again it is. " * 8
    got = one(spark, raw, chunking.sentences)
    assert got[:3] == ["See Dr. Who now", "It was vs. them", "Was it"]
    groups = one(spark, raw, lambda c: chunking.sentence_groups(chunking.sentences(c)))
    assert len(groups) == 2 and groups[0].startswith("See Dr. Who now It was vs. them Was it")


def test_texts_are_handled_in_slices():
    """However many rows a batch has, the strings and words of about a megabyte stand at a time."""
    import pyarrow as pa

    from claimgrain.functions import embedding
    column = pa.array(["x" * 40, None, "", "y" * 100, "é" * 30, "z"])
    cut = list(embedding.slices(column, 100))
    assert pa.concat_arrays(cut).equals(column) and len(cut) == 3
    assert [sum(len((s or "").encode()) for s in part.to_pylist()) for part in cut] == [40, 100, 61]
    assert [len(part) for part in embedding.slices(column[:0], 100)] == [0]
