"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made from a bounded sample of its texts.
A text is compressed with every dictionary; the language that makes it smallest wins, and a
narrow margin to the second is a rejection.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from claimgrain.functions.embedding import SLICE_BYTES, slices

#: Bounds of the sample a model is fitted on.
MAX_LANGUAGES = 64         # the most frequent ones
SAMPLE_DOCS = 64           # per language, by hash of the text
SAMPLE_CHARS = 512         # taken from each of them
SURPLUS = 8                # hashes looked at for each that the sample takes
HASHES = 1 << 40
#: Texts are compressed in blocks, so that a long text is judged by the dictionary rather than
#: by its own beginning.
BLOCK = 4096
#: An optimal parser with three-byte matches: short texts and syllables are told apart well.
LEVEL, STRATEGY, MIN_MATCH = 1, zstandard.STRATEGY_BTOPT, 3
#: Least share by which the best size must be below the second to be accepted.
MARGIN = 0.005
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters with one blank for everything between them: case, digits and
    punctuation say nothing about the language."""
    return F.lower(F.regexp_replace(text, r"\P{L}+", " "))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES,
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Language -> dictionary content, from ``sample_docs`` texts per language at most.

    Texts are chosen by hash of the text, without regard to order or partitions. Copies, and texts
    that differ in case, digits and punctuation alone, count once per language, however many there
    are. Rows with null or letterless text or null language are left out; of a very long text one
    piece is taken; an empty table gives an empty model. The driver gets at most
    max_languages x sample_docs x sample_chars characters (2 million as set).

    From the languages' counts follows a share of the hashes that leaves some eight times the sample;
    only those texts are cleaned and shuffled. Should copies leave a language fewer distinct texts
    than the sample takes, its whole texts are looked at.
    """
    rows = (docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
            .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    top = (rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
           .limit(max_languages).collect())
    names = [r["lang"] for r in top]
    if not names:
        return {}
    share = {r["lang"]: min(1.0, SURPLUS * sample_docs / r["n"]) for r in top}
    sample = _pieces(rows, share, sample_docs, sample_chars)
    found = Counter(r["lang"] for r in sample)
    short = [name for name in names if share[name] < 1 and found[name] < sample_docs]
    if short:
        sample = [r for r in sample if r["lang"] not in short] + _pieces(
            rows, dict.fromkeys(short, 1.0), sample_docs, sample_chars)
    model: dict[str, list[str]] = {}
    for row in sample:
        model.setdefault(row["lang"], []).append(row["piece"])
    return {name: "\n".join(pieces).encode() for name, pieces in model.items()}


def _pieces(rows: DataFrame, share: dict[str, float], sample_docs: int, sample_chars: int) -> list[Row]:
    """``lang, piece`` of the ``sample_docs`` texts with the smallest hashes of each language, out of
    the given share of its hashes."""
    limit = F.create_map(*[F.lit(x) for name, part in share.items() for x in (name, int(part * HASHES))])
    number = F.pmod(F.xxhash64("text"), F.lit(HASHES))
    some = rows.filter(F.col("lang").isin(list(share)) & (number < limit[F.col("lang")]))
    # pieces start at a hashed place, so that shared openings do not fill the dictionary
    plain = some.select("lang", F.trim(letters(F.col("text"))).alias("text"))
    digest = F.xxhash64("text")
    room = F.greatest(F.char_length("text") - sample_chars + 1, F.lit(1))
    piece = F.substring("text", (F.pmod(digest, room) + 1).cast("int"), F.lit(sample_chars))
    first = Window.partitionBy("lang").orderBy("digest", "piece")
    # copies are merged before the shuffle and before they are numbered
    return (plain.select("lang", digest.alias("digest"), piece.alias("piece"))
            .filter(F.trim("piece") != "")
            .groupBy("lang", "digest", "piece").agg(F.lit(1).alias("one"))
            .withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= sample_docs)
            .orderBy("lang", "nth").select("lang", "piece").collect())


class Classifier:
    """Compressors of all languages; made once per task."""

    def __init__(self, model: dict[str, bytes]):
        self.names = sorted(model)
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(model[name],
                                                    dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK, dict_size=len(model[name]), strategy=STRATEGY,
                min_match=MIN_MATCH, write_content_size=False, write_checksum=False,
                write_dict_id=False)
            content.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=content, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]


def classify(docs: DataFrame, model: dict[str, bytes], key: str = "doc_id", text: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``key, lang_pred, score, rejected`` of every whole text; only the text is looked at.

    ``score`` is the share by which the best size is below the second best, 1 when only one
    language was learned. ``rejected`` marks a score below ``margin`` and every ``und``. A null
    text, one without a letter, and every text under an empty model are ``und`` with score 0.
    Equal sizes go to the language that comes first by name (and are rejected). Null keys and
    repeated rows are kept, other columns are not read, an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model))
    # a letterless text need not travel to Python
    rows = rows.select("key", F.when(lettered, letters(F.col("text"))).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    loaded: list[Classifier] = []

    # a scalar function: keys, which may be whole rows, stay in the JVM
    @F.arrow_udf("lang_pred string, score double")
    def judge(column: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(Classifier(shipped.value))
        names, found, scores = loaded[0].names, [], []
        for value in chain.from_iterable(some.to_pylist() for some in slices(column, SLICE_BYTES)):
            if value is None:
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            sizes = loaded[0].sizes(value)
            ranked = sorted(zip(sizes, names))
            found.append(ranked[0][1])
            scores.append(1.0 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0)
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # marked so that readers of the result do not run it again
    judged = rows.select("key", judge.asNondeterministic()("text").alias("found")).select("key", "found.*")
    rejected = (F.col("score") < margin) | (F.col("lang_pred") == UNKNOWN)
    return judged.select(F.col("key").alias(key), "lang_pred", "score", rejected.alias("rejected"))
