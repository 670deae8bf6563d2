"""A training corpus from ``documents``: language, quality, near duplicates, mixture, tokens.

Every stage takes all that its predecessor kept and its decisions take effect; all but the last
return the columns of ``documents``. Between stages the rows are Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrain.llm import bpe, language_id, mixing, ngram_join, quality_rules
from claimgrain.llm.common import written
from claimgrain.llm.queries import byte_bpe


def _row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs meets one of the stage's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def _whole(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) beside ``text``: narrow operators hand the row through, so no text
    is shuffled to find its verdict."""
    return docs.select(_row(docs), "text")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors can tell; ``und`` and narrow margins go.

    Null, blank and letterless texts are ``und`` and go; equal sizes of two languages are a margin
    of nothing and go. A very long text is judged as a whole, in blocks. Without any row that has
    a language nothing can be told apart, so every row goes. Repeated rows are judged each, equally;
    ids may be null or repeat; further columns of any name are handed on; an empty table gives no
    rows.
    """
    model = language_id.fit(docs)
    judged = language_id.classify(_whole(docs), model, key="row")
    return judged.filter("NOT rejected").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects.

    Null and blank texts have fewer words than the least and go. Every rule sees the whole text,
    however long; a measure at its limit passes. Rows that repeat are judged each, equally; ids may
    be null or repeat; further columns of any name are handed on; an empty table gives no rows.
    """
    rows = quality_rules.ledger(_whole(docs), key="row")
    return quality_rules.apply_policy(rows, "v1").filter("kept").select("row.*")


def _identity(doc_id: Column, text: Column) -> Column:
    """Id and text of a row as bytes: they sort by id, a null id last, then by digest of the text."""
    number = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-1 << 63))), 16, "0")
    known = F.when(doc_id.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), number))
    return F.unhex(F.concat(known, F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, then text digest.

    Five-word shingles at a similarity of 0.8. A document is an id (a whole number) with its text:
    texts that share an id are apart unless they link, and rows without an id are documents like
    others, after those with one. Rows that repeat both id and text are one document, of which the
    row with the smallest remaining columns stays, as JSON text. Null and blank texts link with
    nothing: one row per id stays. Very long texts count as a whole; further columns may have any
    name; an empty table gives no rows.
    """
    rows = docs.select(_row(docs), "text", _identity(F.col("doc_id"), F.col("text")).alias("name"))
    groups = written(ngram_join.jaccard_components(rows, key="name", size=5, percent=80), "groups")
    first = (groups.filter("name = component_id").groupBy("name").agg(F.count("*").alias("n")))
    alone = rows.join(first.filter("n = 1"), "name", "left_semi").select("row")
    repeated = rows.join(first.filter("n > 1"), "name", "left_semi")
    chosen = repeated.groupBy("name").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return alone.unionByName(chosen).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture takes of it, the one at a cut whole.

    Rows that repeat an id share its copies evenly, rounded up, so each of them stays if any does;
    a row without an id is known by its text. A null source is a source. Null and blank texts have
    no words, so nothing is taken of them; a very long text counts all its words. Documents are
    taken in the order of a hash of their id. Further columns may have any name; an empty table
    gives no rows.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(
        F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = docs.select(_row(docs), "text", "source", name.alias("name"))
    taken = mixing.mix(rows, key="name")
    copies = taken.groupBy("name").agg(
        F.sum(F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size")))).alias("copies"),
        F.count("*").alias("rows"))
    share = copies.filter("copies > 0").select(
        "name", F.ceil(F.col("copies") / F.col("rows")).cast("int").alias("copies"))
    each = rows.select("row", "name").join(share, "name")
    return each.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, restored``: token ids of every text, and whether
    decoding them gives the text back.

    A null text counts as empty and has no ids. Each row is coded on its own and as a whole,
    however long; ids of documents may be null or repeat; further columns are not read; an empty
    table gives no rows.
    """
    spec = byte_bpe()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("doc_id", "lang", "source", F.xxhash64(text).alias("h")).alias("row"),
                       "text")
    coded = bpe.encode(rows, spec, key="row").select(F.struct("row.*", "n_tokens").alias("row"), "ids")
    back = bpe.decode(coded, spec, key="row")
    return back.select("row.doc_id", "row.lang", "row.source", "row.n_tokens", "ids",
                       (F.xxhash64("text") == F.col("row.h")).alias("restored"))


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage),
          ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage),
          ("bpe", token_stage)]

#: Compression and byte-pair merges are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
