"""Source rows to documents: threads, community posts, courses, pages, abstracts, transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import chunking
from claimgrain.functions.text import (clean_html, normalize_whitespace, strip_blank,
                                       words)
from claimgrain.session import stored

# Running offsets are summed in two levels: inside blocks of this many positions, then over the
# blocks of a thread. It changes no result, only how much one task has to order.
_BLOCK = 1000

COURSE_LESSON = "struct<title:string,content:string,text:string>"
COURSE_MODULE = ("struct<title:string,content:string,text:string,"
                 f"lessons:array<{COURSE_LESSON}>>")
COURSE_SCHEMA = ("array<struct<course_name:string,title:string,content:string,text:string,"
                 f"lessons:array<{COURSE_LESSON}>,modules:array<{COURSE_MODULE}>>>")
THREAD_SCHEMA = ("array<struct<title:string,posts:array<struct<author:string,content:string,"
                 "timestamp:string>>>>")
_REPLY = "struct<author:string,content:string>"
_POST = f"struct<content:string,replies:array<{_REPLY}>>"


def _said(posts: DataFrame) -> DataFrame:
    """``thread_id, position, piece`` of forum posts; empty posts have no piece."""
    content = F.coalesce("content", F.lit(""))
    said = F.when(content != "", F.concat(
        F.lit("["), F.coalesce("author", F.lit("Unknown")), F.lit("]: "), content))
    heading = F.concat(F.lit("Thread: "), F.coalesce("title", F.lit("Forum Thread")))
    piece = F.when(F.col("position") == 0, F.concat_ws("\n\n", heading, said)).otherwise(said)
    return posts.select("thread_id", "position", piece.alias("piece"))


def _replied(posts: DataFrame) -> DataFrame:
    """``thread_id, position, piece`` of community posts: the post, then its replies."""
    content = F.coalesce("content", F.lit(""))
    reply = F.concat(F.lit("[Reply from "), F.coalesce("author", F.lit("member")), F.lit("]: "),
                     content)
    piece = F.when(content == "", F.lit(None).cast("string")).when(
        F.col("position") == 0, content).otherwise(reply)
    return posts.select("thread_id", "position", piece.alias("piece"))


def _spoken(segments: DataFrame) -> DataFrame:
    return segments.select("thread_id", "position", F.col("content").alias("piece"))


def _assemble(pieces: DataFrame, sep: str) -> DataFrame:
    """One document per thread: its pieces in order, empty ones without a trace."""
    text = F.expr(f"listagg(piece, '{sep}') WITHIN GROUP (ORDER BY position)")
    return (pieces.groupBy("thread_id").agg(text.alias("content"))
            .filter(F.coalesce("content", F.lit("")) != "")
            .withColumn("content", normalize_whitespace(F.col("content"))))


def thread_documents(posts: DataFrame) -> DataFrame:
    """Forum threads: title line, then ``[author]: text`` per non-empty post.

    ``posts(thread_id, position, author, content, title)``; positions count up from 0. A
    document is one string; ``thread_chunks`` gives its chunks without building it.
    """
    return _assemble(_said(posts), "\\n\\n")


def community_documents(posts: DataFrame) -> DataFrame:
    """Community posts: the first row is the post, later rows are replies."""
    return _assemble(_replied(posts), "\\n\\n")


def transcript_documents(segments: DataFrame) -> DataFrame:
    """Transcript segments joined by a space in time order."""
    key = F.col("thread_id").cast("string")
    return (_assemble(_spoken(segments), " ")
            .withColumn("source_name", F.concat(F.lit("YouTube:"), key))
            .withColumn("source_url", F.concat(F.lit(dims.VIDEO_URL), key)))


def _offsets(pieces: DataFrame) -> DataFrame:
    """``pieces(thread_id, position, parts)`` with ``start``, the parts of the thread ahead of
    the piece, and ``total``, those of the whole thread."""
    n = F.size("parts").cast("bigint")
    blocks = pieces.withColumn("block", F.floor(F.col("position") / _BLOCK).cast("bigint"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.coalesce(F.sum(n).over(
        ahead("thread_id", "block").orderBy("position", "parts")), F.lit(0)))
    sums = blocks.groupBy("thread_id", "block").agg(F.sum(n).alias("n"))
    whole = Window.partitionBy("thread_id")
    placed = sums.select(
        "thread_id", "block", F.sum("n").over(whole).alias("total"),
        F.coalesce(F.sum("n").over(ahead("thread_id").orderBy("block")), F.lit(0)).alias("before"))
    return (inside.join(placed, ["thread_id", "block"])
            .select("thread_id", "position", "parts", "total",
                    (F.col("before") + F.col("inside")).alias("start")))


def _glue(rows: DataFrame, sep: str) -> DataFrame:
    return rows.groupBy("thread_id", "chunk_index").agg(
        F.expr(f"listagg(piece, '{sep}') WITHIN GROUP (ORDER BY position, start)").alias("content"))


def _paragraph_chunks(pieces: DataFrame, size: int) -> DataFrame:
    """Paragraph groups of each thread, cut from its posts: a post gives its share of every
    group it touches, and the shares of a group meet by number."""
    cut = pieces.filter("piece IS NOT NULL").select(
        "thread_id", "position",
        chunking.paragraphs(normalize_whitespace(F.col("piece"))).alias("parts"))
    placed = _offsets(cut.filter(F.size("parts") > 0))
    n, start = F.size("parts").cast("bigint"), F.col("start")
    low = lambda g: F.greatest(g * size - start, F.lit(0)).cast("int")
    high = lambda g: F.least((g + 1) * size - start, n).cast("int")
    groups = F.transform(
        F.sequence(F.floor(start / size).cast("bigint"),
                   F.floor((start + n - 1) / size).cast("bigint")),
        lambda g: F.struct(g.alias("chunk_index"), F.array_join(
            F.slice("parts", low(g) + 1, high(g) - low(g)), "\n\n").alias("piece")))
    return _glue(placed.select("thread_id", "position", "start", F.inline(groups)), "\\n\\n")


def thread_chunks(posts: DataFrame, size: int = dims.PARAGRAPHS_PER_CHUNK) -> DataFrame:
    """The paragraph chunks of ``thread_documents`` for threads of any length: no task sees
    more of a thread than a block of its posts."""
    return _paragraph_chunks(_said(posts), size)


def community_chunks(posts: DataFrame, size: int = dims.PARAGRAPHS_PER_CHUNK) -> DataFrame:
    return _paragraph_chunks(_replied(posts), size)


def transcript_chunks(segments: DataFrame, size: int = dims.WINDOW_TOKENS,
                      overlap: int = dims.WINDOW_OVERLAP) -> DataFrame:
    """The overlapping word windows of ``transcript_documents``, cut from the segments.

    A segment gives its words to every window that covers them; the last window is the first
    one that reaches the thread's end.
    """
    stride = size - overlap
    cut = _spoken(segments).filter("piece IS NOT NULL").select(
        "thread_id", "position", words(normalize_whitespace(F.col("piece"))).alias("parts"))
    placed = _offsets(cut.filter(F.size("parts") > 0))
    n, start = F.size("parts").cast("bigint"), F.col("start")
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / stride)).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((start - size) / stride) + 1).cast("bigint")
    final = F.least(F.floor((start + n - 1) / stride).cast("bigint"), last)
    low = lambda g: F.greatest(g * stride - start, F.lit(0)).cast("int")
    high = lambda g: F.least(g * stride + size - start, n).cast("int")
    windows = F.transform(F.sequence(first, final), lambda g: F.struct(
        g.alias("chunk_index"), F.array_join(
            F.slice("parts", low(g) + 1, high(g) - low(g)), " ").alias("piece")))
    return _glue(placed.filter(first <= final)
                 .select("thread_id", "position", "start", F.inline(windows)), " ")


def _json_rows(value: Column, schema: str) -> Column:
    """A JSON array, or a single object as an array of one; NULL when broken."""
    text = strip_blank(value)
    return F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
                       .otherwise(text), schema)


def thread_export(files: DataFrame) -> DataFrame:
    """Exported thread files (``stem``, ``value``) to documents, one per thread."""
    threads = files.select("stem", F.posexplode(_json_rows(F.col("value"), THREAD_SCHEMA))
                           .alias("position", "t"))
    said = F.transform(
        F.filter(F.coalesce("t.posts", F.array().cast("array<struct<author:string,content:string,"
                                                      "timestamp:string>>")),
                 lambda p: F.coalesce(p["content"], F.lit("")) != ""),
        lambda p: F.concat(F.lit("["), F.coalesce(p["author"], F.lit("Unknown")), F.lit("]: "),
                           p["content"]))
    heading = F.concat(F.lit("Thread: "), F.coalesce("t.title", F.lit("Forum Thread")))
    return threads.select(
        F.col("stem").alias("source_name"), "position",
        normalize_whitespace(F.array_join(F.concat(F.array(heading), said), "\n\n"))
        .alias("content"))


def community_export(files: DataFrame) -> DataFrame:
    """Exported community files: a list of posts, an object with ``posts``, or one post."""
    schema = f"array<struct<content:string,replies:array<{_REPLY}>,posts:array<{_POST}>>>"
    roots = files.select("stem", F.explode(_json_rows(F.col("value"), schema)).alias("r"))
    own = F.array(F.struct(F.col("r.content").alias("content"), F.col("r.replies").alias("replies")))
    posts = roots.select("stem", F.posexplode(F.coalesce("r.posts", own)).alias("position", "p"))
    replies = F.transform(
        F.filter(F.coalesce("p.replies", F.array().cast(f"array<{_REPLY}>")),
                 lambda r: F.coalesce(r["content"], F.lit("")) != ""),
        lambda r: F.concat(F.lit("[Reply from "), F.coalesce(r["author"], F.lit("member")),
                           F.lit("]: "), r["content"]))
    body = F.filter(F.concat(F.array(F.coalesce("p.content", F.lit(""))), replies),
                    lambda s: s != "")
    return (posts.select(F.concat(F.lit("Skool Community: "), F.col("stem")).alias("source_name"),
                         "position", normalize_whitespace(F.array_join(body, "\n\n"))
                         .alias("content"))
            .filter("content <> ''"))


def course_lessons(files: DataFrame) -> DataFrame:
    """Exported course files to lessons; a missing level stands for its parent object."""
    items = files.select("stem", F.posexplode(_json_rows(F.col("value"), COURSE_SCHEMA))
                         .alias("item_pos", "item"))
    as_module = F.array(F.struct("item.title", "item.content", "item.text", "item.lessons"))
    modules = items.select(
        "stem", "item_pos", F.coalesce("item.course_name", F.col("stem")).alias("course"),
        F.posexplode(F.coalesce("item.modules", as_module)).alias("module_pos", "m"))
    as_lesson = F.array(F.struct("m.title", "m.content", "m.text"))
    lessons = modules.select(
        "stem", "item_pos", "course", "module_pos",
        F.posexplode(F.coalesce("m.lessons", as_lesson)).alias("lesson_pos", "l"))
    content = F.coalesce("l.content", "l.text", F.lit(""))
    return (lessons.filter(content != "").select(
        "stem", "item_pos", "module_pos", "lesson_pos",
        F.concat(F.col("course"), F.lit(": "), F.coalesce("l.title", F.lit("Lesson")))
        .alias("source_name"), normalize_whitespace(content).alias("content")))


#: Lists of children, in the order in which they are looked for.
CHILD_LISTS = ("modules", "lessons", "sections", "units", "children")


def nested_lessons(files: DataFrame) -> DataFrame:
    """Exported course files of any depth to lessons: ``stem, position, source_name, content``.

    An object's children are the first of ``modules``, ``lessons``, ``sections``, ``units`` and
    ``children`` that is a list; an object without any is a lesson, whose text is ``content``, else
    ``text``. The course is the nearest ``course_name`` above the lesson, or the file's stem.
    ``position`` is the path of places from the file's own list down. Blank lessons, list members
    that are no objects and files that are no JSON give nothing.

    One pass per level over the objects that have children, each level written before the next; what
    is left shrinks by the lessons of the level, and the passes end with the deepest.
    """
    field = lambda node, name, kind: F.try_variant_get(node, f"$.{name}", kind)
    root = F.try_parse_json(F.trim("value"))
    listed = F.try_variant_get(root, "$", "array<variant>")
    own = F.when(root.isNotNull(), F.coalesce(listed, F.array(root)))
    level = files.select(F.col("stem"), F.col("stem").alias("course"), F.posexplode(own).alias("place", "node")).select(
        "stem", "course", F.array(F.col("place").cast("string")).alias("path"), "node")
    found = []
    while True:
        kids = F.coalesce(*[field(F.col("node"), name, "array<variant>") for name in CHILD_LISTS])
        course = F.coalesce(field(F.col("node"), "course_name", "string"), F.col("course"))
        is_object = F.schema_of_variant("node").startswith("OBJECT")
        level = stored(level.filter(is_object).select(
            "stem", course.alias("course"), "path", F.when(kids.isNull(), F.struct(
                field(F.col("node"), "title", "string").alias("title"),
                F.coalesce(field(F.col("node"), "content", "string"), field(F.col("node"), "text", "string"),
                           F.lit("")).alias("content"))).alias("lesson"), kids.alias("kids")), "level")
        found.append(level.filter("lesson.content <> ''").select(
            "stem", F.array_join("path", ".").alias("position"),
            F.concat(F.col("course"), F.lit(": "), F.coalesce("lesson.title", F.lit("Lesson"))).alias("source_name"),
            F.col("lesson.content").alias("content")))
        deeper = level.filter("size(kids) > 0").select("stem", "course", "path", F.posexplode("kids").alias("place", "node"))
        if deeper.isEmpty():
            break
        level = deeper.select("stem", "course", F.concat("path", F.array(F.col("place").cast("string"))).alias("path"), "node")
    lessons = reduce(DataFrame.unionByName, found)
    return lessons.withColumn("content", normalize_whitespace(F.col("content")))


def course_pages(files: DataFrame) -> DataFrame:
    """Exported course HTML files to documents."""
    return (clean_html(files, "value", "text")
            .select(F.col("stem").alias("source_name"),
                    normalize_whitespace(F.col("text")).alias("content"))
            .filter("content <> ''"))


def web_documents(pages: DataFrame) -> DataFrame:
    """Pages with text to documents named after their host."""
    return (clean_html(pages, "html", "raw_content").drop("html")
            .filter(F.col("raw_content") != "")
            .withColumn("source_name", F.get(F.split("url", "/"), F.lit(2)))
            .withColumn("source_url", F.col("url"))
            .withColumn("source_type", F.lit("website"))
            .withColumn("evidence_tier", F.lit(3)))


def abstract_documents(records: DataFrame) -> DataFrame:
    """Parsed abstracts to documents; records without title and abstract are left out."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    authors = F.array_join(F.slice("authors", 1, 5), ", ")
    journal = F.coalesce("journal", F.lit(""))
    body = F.concat(
        F.lit("Title: "), title, F.lit("\n\nAbstract: "), abstract,
        F.when(F.size("authors") > 0, F.concat(F.lit("\n\nAuthors: "), authors)).otherwise(""),
        F.when(journal != "", F.concat(F.lit("\nJournal: "), journal)).otherwise(""))
    pmid = F.coalesce("pmid", F.lit(""))
    return (records.filter((title != "") | (abstract != ""))
            .select("pmid", F.concat(F.lit("PubMed:"), pmid).alias("source_name"),
                    F.when(pmid != "", F.concat(F.lit(dims.ABSTRACT_URL), pmid, F.lit("/")))
                    .alias("source_url"),
                    F.lit("pubmed").alias("source_type"), F.lit(1).alias("evidence_tier"),
                    normalize_whitespace(body).alias("content")))
