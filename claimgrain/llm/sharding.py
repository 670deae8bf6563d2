"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.prefix_sum import running_sums


def order_key(text) -> F.Column:
    """60 bits of the text's MD5: equal texts are neighbours, different ones spread evenly."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def byte_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40,
                overhead: int = 16) -> DataFrame:
    """``key, size, text_crc32, shard, slot``: law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus ``overhead`` (a null text has none). Rows stand in
    the order of (text digest, key) and the row with ``before`` bytes ahead of it goes to shard
    ``before * shards / total``: shards are contiguous in that order and their sizes differ by
    less than two rows' sizes. Copies of a text are neighbours and share a shard unless a cut
    falls among them. ``slot`` counts from 0 in each shard. With fewer rows than shards, some
    shards stay empty; an empty table gives no rows. Null keys come first among their copies;
    repeated rows take consecutive places. Only digests and sizes are shuffled, never texts.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.lit(0).cast("bigint").alias("all"), order_key(F.col(text)).alias("digest"),
        F.col(key).alias("key"),
        (F.octet_length(value) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"))
    placed = running_sums(rows, "all", ["digest", "key"], "size")
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    sharded = placed.withColumn("shard", F.expr(f"(before * {shards}) div {total}").cast("int"))
    first = sharded.groupBy("shard").agg(F.min("position").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        (F.col("position") - F.col("first")).alias("slot"))
