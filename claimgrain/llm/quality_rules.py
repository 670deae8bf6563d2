"""Quality rules as a bitmask ledger, with DataFrame expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule. Versioned policies are masks over those bits, and ablations are sums over the
distinct bit patterns, so neither looks at a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import GAP, let

SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 5

#: Rule -> when a document fails it, over the measurements. A rule's bit is its place here;
#: new rules are added at the end.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "letterless_words": "100 * n_letter_words < 70 * n_words",
}
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": BASE_RULES,
    "v1": tuple(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_capitals", "n_letter_words"]


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeated_words(words: Column, size: int = WINDOW_WORDS) -> Column:
    """Words inside windows of ``size`` words that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Most texts have no repeat, which one
    hash set shows. For the others (hash, place) pairs are sorted, those with an equal
    neighbour are kept, and each kept place covers the words up to the next one, ``size`` at
    most: n log n, whatever repeats.
    """
    last = F.size(words) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(size)]))

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def kept(rows: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
            return F.array_sort(F.transform(
                F.filter(rows, lambda r, i: same(i, i - 1) | same(i, i + 1)), lambda r: r["i"]))

        def total(places: Column) -> Column:
            gap = lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(size)), F.lit(size))
            return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, g: a + g)

        return let(placed, lambda rows: let(kept(rows), total))

    counted = let(hashes, lambda found: F.when(
        F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0))
    return F.when(last >= 0, counted).otherwise(0)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``fail_bits`` of every whole text.

    Words are runs of characters other than blanks; a null or empty text has none and fails
    ``few_words``. Lines count when they hold a word. ``n_capitals`` counts capital letters of
    any script, ``n_letter_words`` words that hold a letter. Null keys and repeated rows are
    kept, other columns are not read, an empty table gives no rows. Narrow: no shuffle, and
    each text is split into words once.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), value.alias("text"))
    blank_free = F.filter(F.split("text", GAP), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    # joined words: their characters alone, for counts that do not depend on borders
    measured = rows.select("key", let(blank_free, lambda w: let(
        F.array_join(w, " "), lambda joined: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.char_length(joined) - F.greatest(F.size(w) - 1, F.lit(0))).cast("bigint")
            .alias("word_chars"),
            F.regexp_count(joined, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            _repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.regexp_count(joined, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
            F.regexp_count(joined, F.lit(r"(?<![^ ])[^ \p{L}]*+\p{L}")).cast("bigint")
            .alias("n_letter_words")))).alias("m"),
        let(lines, lambda s: F.struct(
            F.size(s).cast("bigint").alias("n_lines"),
            (F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("n_dup_lines")))
        .alias("s"))
    flat = measured.select("key", "m.*", "s.*")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0) for bit, rule in enumerate(RULES.values())])
    return flat.select(F.col("key").alias(key), *MEASURES, bits.cast("bigint").alias("fail_bits"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no failed rule is in the policy's mask."""
    return rows.withColumn("policy", F.lit(policy)).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(mask(POLICIES[policy])) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """``policy, rule, n_failed, n_only``: documents a rule fails, and those that the policy
    would keep without that rule.

    The ledger is first summed per bit pattern (2^rules rows at most), then each rule of each
    policy is looked up in those patterns.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    entries = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                 F.lit(mask([r])).cast("bigint").alias("bit"),
                 F.lit(mask(rules)).cast("bigint").alias("mask"))
        for p, rules in POLICIES.items() for r in rules])
    failed = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return (patterns.select("*", F.inline(entries)).groupBy("policy", "rule")
            .agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only")))
