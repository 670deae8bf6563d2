"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs, sorted, merged where neighbours share a
role, and concatenated. Control strings inside texts are escaped reversibly, so the formatted
text can be read back turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the template's control strings ----------------------------------------
TURN = "<|turn|>"      # before the role
BODY = "<|body|>"      # between role and text
PART = "<|part|>"      # between the texts of merged turns
END = "<|end|>"        # after the last text
# Strings of this and other chat templates that a text must not carry as such. A run of
# backslashes behind the first character is part of the pattern: escaping adds one.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|/?<SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|/?<SYS>>)"


def escape(text: Column) -> Column:
    """One backslash behind the first character of every control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """``key, formatted, segments``: one row per conversation.

    Turns are ordered by ``turn``, ties by role, then text, nulls first; repeated rows are
    turns of their own. A null role or text counts as empty; rows with a null key are one
    conversation. Adjacent turns of one role share a header and are set apart by ``PART``.
    ``segments(text, loss)`` are the pieces whose concatenation is ``formatted``; ``loss`` is
    true for the (escaped) texts of ``trained_role`` and for nothing else. An empty table gives
    no rows; other columns are not read. A conversation becomes one string, so its turns meet
    in one task; they are combined into arrays before the shuffle.
    """
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text"))).alias("turns"))
    # positions of turns whose role differs from the turn before
    turn_at = lambda i: F.get("turns", i)
    starts = F.filter(
        F.transform("turns", lambda t, i: F.when(
            (i == 0) | (turn_at(i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
    marked = ordered.select("key", "turns", starts.alias("starts"))
    # a group's texts are the slice up to the next start: each turn is copied once
    stop = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    groups = F.transform("starts", lambda s, k: F.struct(
        turn_at(s)["role"].alias("role"),
        F.transform(F.slice("turns", s + 1, stop(k) - s), lambda t: t["text"]).alias("texts")))
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    plain = F.lit(False)
    pieces = F.flatten(F.transform(groups, lambda g: F.concat(
        F.array(piece(F.concat(F.lit(TURN), escape(g["role"]), F.lit(BODY)), plain)),
        F.flatten(F.transform(g["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, "").otherwise(PART), plain),
            piece(escape(t), g["role"] == trained_role)))),
        F.array(piece(F.lit(END), plain)))))
    segments = marked.select("key", pieces.alias("segments"))
    return segments.select(
        F.col("key").alias(key),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments")


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of the single turns, read from a formatted conversation."""
    block = F.filter(F.split(formatted, r"\Q" + TURN + r"\E"), lambda b: b != "")

    def texts(b: Column) -> Column:
        body = F.substring_index(b, BODY, -1)
        return F.split(F.substring_index(body, END, 1), r"\Q" + PART + r"\E")

    return F.flatten(F.transform(block, lambda b: F.transform(texts(b), lambda t: F.struct(
        unescape(F.substring_index(b, BODY, 1)).alias("role"), unescape(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
