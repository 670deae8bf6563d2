"""Connected components of an edge table, as a series of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import erase, written_at


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; see ``components_at``."""
    return components_at(edges)[0]


def components_at(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, root`` for every node of ``edges(a, b)``; the root is the component's smallest.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then its
    smaller ones, to the smallest it knows. Each round is written to the shared folder; edges
    never outgrow their first number by more than the nodes, and rounds follow the logarithm
    of a component's size. Edges with a null end and loops are left out. A round's table is erased
    when the next one stands; the folder of the last, which the result reads, is returned beside it.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"),
                         (F.col("a") != F.col("b")).alias("real"))
    current, path = written_at(pairs.filter("real").select("u", "v").distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return (current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
                    .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))
                                 .distinct())), path
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy(F.col("u").alias("x")).agg(
            F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(smallest, F.col("u") == F.col("x")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large, large_at = written_at(large.distinct(), "edges")
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        again = small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        last, (current, path) = path, written_at(again, "edges")
        for done in (last, large_at):
            erase(spark, done)
