"""URL filters: host-suffix and path-prefix expressions met with a rule list.

Every distinct URL is expanded into expressions ``host suffix + path prefix``. Each gets a
digest; the expressions meet the rules in an equi-join on the first 32 bits, the full digests
confirm, and the longest rule wins. No step compares every URL with every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import let, lower_ascii

RULE_SCHEMA = "host string, path string, action string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.md5(expression.cast("binary"))


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(n) for n in values]) if values else F.array().cast("array<int>")


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The last ``n`` labels of a host for each ``n`` of ``counts`` that it has: ``a.b.c`` and
    ``[1, 2]`` -> ``[c, b.c]``."""
    return let(F.split(host, r"\."), lambda labels: F.transform(
        F.filter(_numbers(counts), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` (distinct, not null) with the winning ``rule`` and ``verdict``; others absent.

    Only host suffixes of label counts and path prefixes of lengths that occur among the rules are
    made, so a URL gives (distinct rule label counts) x (distinct rule path lengths) expressions at
    most, however long its host and path are. Ties between rules of one length: ``block`` before
    ``allow``, then the rule text.
    """
    known = (rules.select(
        F.concat(lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit("")))
        .alias("rule"), F.char_length(F.coalesce("path", F.lit(""))).alias("n"),
        F.size(F.split(F.coalesce("host", F.lit("")), r"\.")).alias("labels"),
        F.col("action").alias("verdict")).filter("rule <> '' AND verdict IS NOT NULL").distinct())
    # one small integer per distinct path length and label count, at most as many as the longest
    # rule has characters
    lengths, counts = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("n", "labels"))
    path = F.col("path")
    allowed = F.filter(_numbers(lengths), lambda n: n <= F.char_length(path))
    expanded = (urls.select("url", url_host(F.col("url")).alias("host"),
                            url_path(F.col("url")).alias("path"))
                .filter("host <> ''")
                .select("url", F.transform(allowed, lambda n: F.substring(path, F.lit(1), n))
                        .alias("prefixes"), F.explode(host_suffixes(F.col("host"), counts)).alias("h"))
                .select("url", "h", F.explode("prefixes").alias("prefix"))
                .select("url", _digest(F.concat("h", "prefix")).alias("digest"))
                .withColumn("short", _short(F.col("digest"))))
    keyed = known.select("rule", "verdict", _digest(F.col("rule")).alias("rule_digest"))
    keyed = keyed.withColumn("short", _short(F.col("rule_digest")))
    hits = expanded.join(keyed, "short").filter("digest = rule_digest")
    best = F.max(F.struct(F.char_length("rule").alias("n"), (F.col("verdict") == "block").alias("b"),
                          F.col("rule"), F.col("verdict")))
    return (hits.groupBy("url").agg(best.alias("best"))
            .select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))


def url_filter(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` for every row of ``pages``.

    ``rules(host, path, action)``: a rule fits its host and all subdomains when the URL's path
    starts with the rule's path; the longest rule wins; without a fitting rule ``rule`` is null
    and ``verdict`` is ``default``. A null URL, or one without ``://``, has empty host and path
    and no rule. Repeated rows stay repeated, a null key is kept, an empty rule list gives the
    default everywhere, an empty table gives no rows, and other columns of ``pages`` are not read,
    whatever their names. A very long URL costs its length times the label counts and path lengths of
    the rules.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    judged = match_rules(rows.select("url").filter("url IS NOT NULL").distinct(), rules)
    return rows.join(judged, "url", "left").select(
        F.col("key").alias(key), url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
