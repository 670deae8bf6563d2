"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrain.llm.common import WORD, written
from claimgrain.llm.prefix_sum import running_sums

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with its ``number`` in code-point order (null last) and
    ``target``.

    The words of all sources are shared by weight; a target stops at ``max_epochs`` times its
    source and the excess is shared again by weight until none is above. Put differently, one
    level L of words per weight holds for all sources below their stop. With the sources in
    the order of stop per weight, those that stop come first, so L follows from running sums.
    The windows see one row per source.
    """
    number = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        (F.col("number") % len(weights) + 1).cast("int"))
    rows = (sizes.withColumn("number", (F.row_number().over(number) - 1).cast("bigint"))
            .withColumn("weight", pick.cast("double"))
            .withColumn("stop", F.col("source_size") * F.lit(max_epochs)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    levels = (rows
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("ahead_stop", F.sum("stop").over(up_to) - F.col("stop"))
              .withColumn("open_weight", F.sum("weight").over(everything)
                          - F.sum("weight").over(up_to) + F.col("weight"))
              .withColumn("level", (F.col("total") - F.col("ahead_stop")) / F.col("open_weight")))
    # the level holds from the first source that does not stop under it
    fits = F.col("level") * F.col("weight") <= F.col("stop")
    level = F.min(F.when(fits, F.struct(
        (F.col("stop") / F.col("weight")).alias("ratio"), F.col("number"), F.col("level"))))
    return levels.withColumn("open", level.over(everything)).select(
        "source", "number", "source_size",
        F.when(F.col("open").isNull(), F.col("stop").cast("double"))
        .otherwise(F.least(F.col("stop").cast("double"), F.col("open.level") * F.col("weight")))
        .alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``key, source, size, source_size, target, taken``: one row per document.

    Within a source, documents stand in the order of a hash of their key (ties: key, size).
    The source's budget is its target without fraction: as many whole epochs as fit, then
    documents from the start of the order until the budget is used up; the document at the cut
    gives the words that are left. So the ``taken`` words of a source add up to its budget
    exactly, and no document passes ``max_epochs`` times its size. A null source is a source;
    a null text has size 0 and gives nothing; null keys hash alike; repeated rows count each.
    Reruns agree: nothing depends on chance or on partitions. An empty table gives no rows.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    # the texts are read once: what follows needs two short numbers per document
    rows = written(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("random")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, max_epochs)
    numbers = goals.select(F.col("source").alias("named"), "number")
    numbered = rows.join(numbers, F.col("source").eqNullSafe(F.col("named"))).select(
        "number", "random", "key", "size")
    placed = running_sums(numbered, "number", ["random", "key", "size"], "size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return placed.join(goals, "number").select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        (F.col("size") * epochs + last).cast("bigint").alias("taken"))
