"""Column functions that cut one text into an array of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions.text import BLANK, strip_blank

# ---- fixed values: where sentences and paragraphs end ---------------------------------------
# A sentence ends at .!? plus blanks, unless the mark follows a known abbreviation or a
# capital plus small letter (Dr, Ms, ...).
SENTENCE_END = (r"(?<!\b(?:Dr|Mr|Mrs|Ms|Prof|St|vs|etc|Fig|al))(?<![A-Z][a-z])"
                r"[.!?]+" + BLANK + "+")
PARAGRAPH_END = r"\n" + BLANK + r"*\n"


def token_windows(words: Column, size: int = dims.WINDOW_TOKENS,
                  overlap: int = dims.WINDOW_OVERLAP) -> Column:
    """Overlapping word windows; the last one ends with the text.

    ``words`` should be a materialised column (see ``operators.ingest``), so that the
    text is split once however many windows it has.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    stride = size - overlap
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(words, i * stride + 1, size), " "))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def group_parts(parts: Column, size: int, sep: str) -> Column:
    """Join every ``size`` consecutive parts into one chunk."""
    n = F.size(parts)
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / size).cast("int"))),
        lambda i: F.array_join(F.slice(parts, i * size + 1, size), sep))
    return F.when(n > 0, groups).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, PARAGRAPH_END), strip_blank)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_END), strip_blank)
    return F.filter(parts, lambda p: p != "")


def paragraph_groups(parts: Column, size: int = 3) -> Column:
    return group_parts(parts, size, "\n\n")


def sentence_groups(parts: Column, size: int = dims.SENTENCES_PER_CHUNK) -> Column:
    return group_parts(parts, size, " ")
