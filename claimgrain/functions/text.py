"""Column functions that clean text: markup removal, whitespace, boilerplate, language."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimgrain.functions.embedding import SLICE_BYTES, slices

# Unicode whitespace as one class, so that Java, RE2 and Python agree on what a blank is.
BLANK = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
BLANK_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
               + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")

# The blanks an ASCII text can hold, as single characters: one table lookup each in Java.
ASCII_BLANK = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f ]"
WIDE_BLANKS = [c for c in BLANK_CHARS if ord(c) > 0x7F]

# Characters NFKC leaves alone, whatever stands next to them: ASCII, most Latin letters and
# the usual quotation marks and dashes. Text made only of these skips the Python step.
NFKC_STABLE = (r"^[\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}"
               r"\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
               r"\x{2013}\x{2014}\x{2018}-\x{201e}\x{20ac}]*+$")

# ---- fixed values: phrases that start a boilerplate run (removed up to the end of line) ----
BOILERPLATE_PHRASES = [
    r"accept all cookies?",
    r"privacy policy",
    r"terms (of service|and conditions)",
    r"cookie (policy|notice|settings)",
    r"subscribe to our newsletter",
    r"all rights reserved",
    r"copyright \d{4}",
    r"skip to (main )?content",
]
# A lower-cased text holding none of these cannot match any boilerplate pattern.
BOILERPLATE_HINTS = ["cookie", "privacy policy", "terms ", "subscribe to our", "all rights",
                     "copyright ", "skip to ", "menu", "share "]

# ---- fixed values: markup -----------------------------------------------------------------
DROPPED_ELEMENTS = ["script", "style", "nav", "footer", "header"]
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&quot;": '"', "&#39;": "'",
    "&copy;": "©", "&middot;": "·",
}


def is_ascii(col: Column) -> Column:
    return F.length(col) == F.octet_length(col)


def holds_any(col: Column, needles: list[str]) -> Column:
    """Byte-wise substring tests, far cheaper than one regular expression."""
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def strip_blank(col: Column) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.trim(col, F.lit(BLANK_CHARS))


def _mapped(column: pa.Array, change) -> pa.Array:
    """``change`` of every text that is not null; the strings of a slice are held at a time."""
    done = [pa.array([None if s is None else change(s) for s in some.to_pylist()], pa.string())
            for some in slices(column, SLICE_BYTES)]
    return pa.concat_arrays(done)


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _mapped(text, lambda s: unicodedata.normalize("NFKC", s))


@F.arrow_udf(StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return _mapped(text, html.unescape)


# Marked as non-deterministic so that the optimizer never copies the columns built on them
# into their readers: long cleaning chains would otherwise run once per reference.
_nfkc, _unescape = _nfkc.asNondeterministic(), _unescape.asNondeterministic()


def nfkc(col: Column) -> Column:
    """Unicode NFKC. Only text with characters that NFKC can change is sent to Python.

    Give it a stored column, not a long expression: the value is read three times.
    """
    return F.coalesce(_nfkc(F.when(~is_ascii(col) & ~col.rlike(NFKC_STABLE), col)), col)


def collapse_blank(col: Column) -> Column:
    """Runs of spaces to one, three or more newlines to two, then trim.

    Text with nothing to collapse skips the regular expressions.
    """
    spaced = holds_any(col, ["  ", "\t", "\xa0", "\u200b", "\ufeff"])
    col = F.when(spaced, F.regexp_replace(col, r"[ \t\x{a0}\x{200b}\x{feff}]+", " ")).otherwise(col)
    col = F.when(col.contains("\n\n\n"), F.regexp_replace(col, r"\n{3,}", "\n\n")).otherwise(col)
    return strip_blank(col)


def normalize_whitespace(col: Column) -> Column:
    return collapse_blank(nfkc(F.coalesce(col, F.lit(""))))


def boilerplate_patterns() -> list[str]:
    """The ten removal patterns in the order they are applied."""
    tail = r"[^\n]*\n?"
    return ([p + tail for p in BOILERPLATE_PHRASES]
            + [rf"menu{BLANK}*(?:\n|$)", rf"^{BLANK}*share (this|article|post){tail}"])


def drop_boilerplate(col: Column) -> Column:
    """Delete boilerplate runs. Texts without a hint word keep their value untouched."""
    # two letters outside ASCII also match s and k when case is ignored
    hinted = (holds_any(F.lower(col), BOILERPLATE_HINTS)
              | (~is_ascii(col) & holds_any(col, ["\u017f", "\u212a"])))
    cleaned = col
    for pattern in boilerplate_patterns():
        # d: only \n ends a line; u: letters fold as Unicode
        cleaned = F.regexp_replace(cleaned, "(?imdu)" + pattern, "")
    return F.when(hinted, cleaned).otherwise(col)


def remove_boilerplate(col: Column) -> Column:
    return normalize_whitespace(drop_boilerplate(F.coalesce(col, F.lit(""))))


def _decode_entities(col: Column) -> Column:
    for entity, char in ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def decode_entities(col: Column) -> Column:
    """Decode character references once. Texts with rarer ones go through Python."""
    known = "|".join(e.strip("&;") for e in [*ENTITIES, "&amp;"])
    rare = col.rlike(rf"&(?!(?:{known});)#?[0-9A-Za-z]+;")
    return F.coalesce(_unescape(F.when(rare, col)), _decode_entities(col))


_NAMES = "|".join(DROPPED_ELEMENTS)


def element_patterns() -> list[str]:
    """One pattern per dropped element, open tag to close tag."""
    return [rf"(?is)<{t}(?=[\s>/])[^>]*>.*?</{t}\s*>" for t in DROPPED_ELEMENTS]


# A comment, declaration or tag: what separates two text nodes.
TAG = r"(?s)<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>"
# An attribute value that holds a ">" before its closing quote.
QUOTED_END = r"""<[a-zA-Z][^<>]*=\s*(?:"[^"<>]*>|'[^'<>]*>)"""


def needs_tree(col: Column) -> Column:
    """Pages the patterns would misread: dropped elements that nest or stay open, and tags with
    a ``>`` inside an attribute."""
    marks = F.lower(F.array_join(F.regexp_extract_all(
        col, F.lit(rf"(?i)(</?(?:{_NAMES}))(?=[\s>/])"), F.lit(1)), ""))
    pairs = "|".join(f"<{t}</{t}" for t in DROPPED_ELEMENTS)
    return ~marks.rlike(f"^(?:{pairs})*$") | col.rlike(QUOTED_END)


def visible_text(col: Column) -> Column:
    """Dropped elements removed, text nodes joined by one space; references undecoded."""
    col = F.coalesce(col, F.lit(""))
    for pattern in element_patterns():
        col = F.regexp_replace(col, pattern, "<br>")
    nodes = F.transform(F.split(col, TAG), strip_blank)
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


class _Page(HTMLParser):
    """Visible text of one page: a stack of open elements, text kept outside dropped ones. A
    close tag closes everything opened since its element; without such an element it is
    ignored."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
            "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped = 0
        self.nodes: list[str] = []
        self.node: list[str] = []

    def flush(self) -> None:
        text = "".join(self.node).strip()
        if text:
            self.nodes.append(text)
        self.node = []

    def handle_starttag(self, tag, attrs) -> None:
        self.flush()
        if tag not in self.VOID:
            self.open.append(tag)
            self.dropped += tag in DROPPED_ELEMENTS

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self.flush()
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.dropped -= last in DROPPED_ELEMENTS
                if last == tag:
                    break

    def handle_data(self, data) -> None:
        if not self.dropped:
            self.node.append(data)

    def handle_comment(self, data) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    @classmethod
    def text(cls, html_text: str) -> str:
        page = cls()
        page.feed(html_text)
        page.close()
        page.flush()
        return " ".join(page.nodes)


@F.arrow_udf(StringType())
def _tree_text(html_text: pa.Array) -> pa.Array:
    return _mapped(html_text, _Page.text)


_tree_text = _tree_text.asNondeterministic()


def clean_html(df: DataFrame, column: str, into: str) -> DataFrame:
    """Text of a page column. In steps, so that the markup chain runs once per row and the
    decoder reads its stored result. Well-paired pages stay in the JVM; the others are read by
    a tree parser."""
    html_text = F.col(column)
    hard = F.when(needs_tree(F.coalesce(html_text, F.lit(""))), html_text)
    return (df.withColumn("_tree", _tree_text(hard))
            .withColumn(into, F.when(F.col("_tree").isNull(), visible_text(html_text)))
            .withColumn(into, F.coalesce("_tree", decode_entities(F.col(into)))).drop("_tree"))


def detect_language(col: Column) -> Column:
    """'en' for any text of 20 characters or more, NULL otherwise."""
    return F.when(F.length(col) >= 20, F.lit("en"))


# ---- fixed values: frequent words of each language, for the vote ---------------------------
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "im", "ein", "eine",
           "nicht", "auf", "des", "dem", "sich"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "are", "by", "with", "as",
           "on", "be", "at", "this"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "por", "con", "del", "se",
           "para", "es", "su", "al"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "pour", "dans", "sur", "qui",
           "au", "du", "par", "est"],
}


def vote_language(col: Column) -> Column:
    """The language most of whose frequent words stand in the text; ties go to the first by
    name, NULL without any. One count per language, no explode."""
    lowered = F.lower(col)
    votes = F.array(*[F.struct(
        F.regexp_count(lowered, F.lit(rf"(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])")).alias("n"),
        F.lit(-i).alias("place"), F.lit(lang).alias("lang"))
        for i, (lang, words) in enumerate(sorted(STOP_WORDS.items()))])
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["lang"])


def words(col: Column) -> Column:
    """Whitespace-separated words; empty array for blank text."""
    trimmed = strip_blank(col)
    wide = ~is_ascii(trimmed) & holds_any(trimmed, WIDE_BLANKS)
    return (F.when(trimmed == "", F.array().cast("array<string>"))
            .when(wide, F.split(trimmed, BLANK + "+"))
            .otherwise(F.split(trimmed, ASCII_BLANK + "+")))
