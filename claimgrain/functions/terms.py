"""Term-list predicates over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrain.functions.text import holds_any


def contains_any(text: Column, terms: list[str]) -> Column:
    """True if the lower-cased text contains any term. NULL text contains none."""
    return holds_any(F.lower(F.coalesce(text, F.lit(""))), terms)


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms found, in list order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(lowered.contains(t), F.lit(t)) for t in terms])
    return F.filter(found, lambda t: t.isNotNull())


def any_contains(texts: Column, terms: list[str]) -> Column:
    """True if any element of an array of texts contains any term."""
    return F.coalesce(F.exists(texts, lambda t: contains_any(t, terms)), F.lit(False))
