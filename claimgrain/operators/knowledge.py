"""Claims and triples: parsing of model responses, vocabulary filter, entity linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrain import dims

CLAIM_SCHEMA = ("array<struct<claim_text:string,peptide_mentioned:array<string>,"
                "condition_mentioned:array<string>,claim_type:string,certainty_language:string,"
                "confidence:double,supporting_quote:string>>")
TRIPLE_SCHEMA = ("array<struct<subject:string,subject_type:string,relation:string,"
                 "object:string,object_type:string,confidence:double,evidence_tier:int>>")


def fenced_block(raw: Column, any_fence: bool = True) -> Column:
    """The text inside the first json fence, else inside any fence, else all of it."""
    after = lambda mark: F.get(F.split(raw, mark, 3), F.lit(1))
    inside = lambda mark: F.get(F.split(after(mark), "```", 2), F.lit(0))
    body = F.when(raw.contains("```json"), inside("```json"))
    if any_fence:
        body = body.when(raw.contains("```"), F.get(F.split(raw, "```", 3), F.lit(1)))
    return F.trim(body.otherwise(raw), F.lit(" \t\r\n"))


def parse_array(body: Column, schema: str) -> Column:
    """JSON array or single object as an array of structs; empty when it does not parse."""
    as_list = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    valid = F.try_parse_json(as_list).isNotNull() & as_list.startswith("[")
    parsed = F.when(valid, F.from_json(as_list, schema))
    return F.filter(F.coalesce(parsed, F.array().cast(schema)), lambda c: c.isNotNull())


def parse_claims(responses: DataFrame) -> DataFrame:
    """Claims of every response, stamped with the chunk and tier they came from."""
    body = responses.withColumn("body", fenced_block(F.col("raw")))
    return (body.select("chunk_id", "evidence_tier",
                        F.posexplode(parse_array(F.col("body"), CLAIM_SCHEMA))
                        .alias("position", "claim"))
            .select(F.col("chunk_id").alias("source_chunk_id"), "evidence_tier", "position",
                    "claim.*"))


def unparsed_responses(responses: DataFrame) -> DataFrame:
    """Responses that yield nothing because their JSON is broken."""
    body = responses.withColumn("body", fenced_block(F.col("raw")))
    return body.filter(F.try_parse_json(F.col("body")).isNull()).select("chunk_id", "raw")


def claim_lines(claims: DataFrame) -> DataFrame:
    """The claim set of a chunk as ``- [tier] text`` lines, in order of appearance."""
    line = F.format_string("- [%s] %s", F.coalesce(F.col("evidence_tier").cast("string"),
                                                   F.lit("?")), F.col("claim_text"))
    return (claims.filter(F.coalesce("claim_text", F.lit("")) != "")
            .groupBy("source_chunk_id")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("position", line.alias("line")))),
                lambda r: r["line"]), "\n").alias("claims_text")))


def parse_triples(responses: DataFrame, floor: float | None = None) -> DataFrame:
    """Triples within the relation vocabulary; optionally those above a confidence floor."""
    body = responses.withColumn("body", fenced_block(F.col("raw"), any_fence=False))
    triples = (body.select("chunk_id", F.posexplode(parse_array(F.col("body"), TRIPLE_SCHEMA))
                           .alias("position", "triple"))
               .select(F.col("chunk_id").alias("source_chunk_id"), "position", "triple.*")
               .filter(F.col("relation").isin(dims.RELATIONS)))
    return triples if floor is None else triples.filter(F.col("confidence") >= floor)


def synonym_table(spark) -> DataFrame:
    """name -> canonical, for the fixed entity list (under a hundred rows)."""
    pairs = {name.lower(): canonical for canonical, names in dims.SYNONYMS.items()
             for name in [canonical, *names]}
    rows = ", ".join(f"('{name}', '{canonical}')" for name, canonical in pairs.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, canonical)")


#: Synonyms of so many letters and nothing else read as ordinary words.
SHORT_NAME = 4


def entity_names(spark) -> DataFrame:
    """``name, canonical, ambiguous`` of the fixed entity list.

    A synonym is ambiguous when it is a short plain word or stands for several entities: links and
    mentions by it are kept and flagged. A canonical name never is.
    """
    shared = Window.partitionBy("name")
    plain = F.col("name").rlike(rf"^\p{{L}}{{1,{SHORT_NAME}}}$")
    return synonym_table(spark).withColumn("ambiguous", (F.col("name") != F.lower("canonical"))
                                           & (plain | (F.count("*").over(shared) > 1)))


def link_entities(triples: DataFrame, columns: tuple[str, ...] = ("subject", "object"),
                  flag: bool = False) -> DataFrame:
    """Canonical names by exact match of the trimmed lower-cased name.

    With ``flag``, ``<column>_ambiguous`` tells whether the link rests on an ambiguous synonym."""
    table = entity_names(triples.sparkSession) if flag else synonym_table(triples.sparkSession)
    for column in columns:
        kept = [F.col("ambiguous").alias("_ambiguous")] if flag else []
        names = F.broadcast(table.select(F.col("name").alias("_name"),
                                         F.col("canonical").alias("_canonical"), *kept))
        key = F.lower(F.trim(F.col(column)))
        triples = (triples.join(names, key == F.col("_name"), "left")
                   .withColumn(column, F.coalesce("_canonical", F.trim(F.col(column)))))
        if flag:
            triples = triples.withColumn(f"{column}_ambiguous", F.coalesce("_ambiguous", F.lit(False)))
        triples = triples.drop("_name", "_canonical", "_ambiguous")
    return triples


# ---- misspelt names ---------------------------------------------------------------------------

def _shortened(word: Column) -> Column:
    """Hashes of a word and of the word without each of its characters."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1)))
    cut = F.transform(places, lambda i: F.xxhash64(F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), cut))


def misspelt_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """``word, name, edits`` of all words and names at most one edit apart (insert, delete, replace).

    ``words(word)`` and ``names(name)``, compared as they are written. Two strings within one edit
    share a form with at most one character deleted, so candidates meet in an equi-join on hashes of
    those forms and the edit distance decides; no word is compared with all names. Equal strings
    have 0 edits. Repeated words and names count once; null and empty ones take no part; lengths
    that no name comes near are left out first, so a very long word costs nothing. An empty side
    gives no rows.
    """
    span = names.filter("name <> ''").agg(F.min(F.char_length("name")).alias("least"),
                                          F.max(F.char_length("name")).alias("most"))
    asked = words.filter("word <> ''").select("word").distinct()
    near = asked.join(F.broadcast(span), F.char_length("word").between(F.col("least") - 1, F.col("most") + 1))
    left = near.select("word", F.explode(_shortened(F.col("word"))).alias("form"))
    right = names.filter("name <> ''").select("name").distinct().select(
        "name", F.explode(_shortened(F.col("name"))).alias("form"))
    edits = F.levenshtein("word", "name", 1)
    return (left.join(right, "form").select("word", "name").distinct()
            .withColumn("edits", edits).filter(F.col("edits") >= 0))
