"""Byte-level BPE: texts to token ids and back, inside Arrow tasks.

Words are cut by the vocabulary's pattern; each distinct word of a task is merged once. A short
word keeps its part boundaries and the merge ranks of adjacent parts in two contiguous arrays:
find the smallest rank, delete that boundary, refresh the two neighbouring ranks, repeat. A
long word (no blank for hundreds of bytes) would make that scan quadratic, so its ranks stand
in a heap over the same boundaries; the merges and their order are the same.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import fields, map_slices

# Fixed value: the pattern that cuts text into words before merging.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NO_RANK = 1 << 60
LONG_WORD = 128        # bytes from which ranks stand in a heap
CACHED_WORDS = 400_000  # words remembered per task; the memory is cleared when full
CACHED_BYTES = 64      # longer words are not remembered


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids and merge ranks of one tokenizer file; small, made once per task from its text."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, letters = data["model"], _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        vocab = model["vocab"]
        self.first = [vocab[letter] for letter in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]))
        for token, number in vocab.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
        self.special = {}
        for token in data["added_tokens"]:
            self.bytes_of[token["id"]] = token["content"].encode()
            self.special[token["content"]] = np.array([token["id"]], "<u4").tobytes()
        self.words = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.special_cut = regex.compile(
            "(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, bytes] = {}

    def _short(self, ids: list[int]) -> list[int]:
        merges = self.merges.get
        ranks = [merges(pair, (NO_RANK, 0)) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == NO_RANK:
                break
            at = ranks.index(best)
            ids[at] = best[1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = merges((ids[at - 1], ids[at]), (NO_RANK, 0))
            if at < len(ranks):
                ranks[at] = merges((ids[at], ids[at + 1]), (NO_RANK, 0))
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges.get, len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1)
                if (m := merges((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = joined, -1
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
                if m := merges((joined, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, joined, ids[after[i]], m[1]))
            if ahead[i] >= 0 and (m := merges((ids[ahead[i]], joined))):
                heapq.heappush(heap, (m[0], ahead[i], ids[ahead[i]], joined, m[1]))
        return [t for t in ids if t >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word, packed as little-endian unsigned 32-bit integers."""
        ids = [self.first[b] for b in word.encode()]
        short = len(ids) < LONG_WORD
        packed = np.array(self._short(ids) if short else self._long(ids), "<u4").tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        known, word = self.cache.get, self.word
        return b"".join([known(w) or word(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        if self.special_cut is None or not any(name in text for name in self.special):
            return self._plain(text)
        return b"".join([self.special.get(piece) or self._plain(piece)
                         for piece in self.special_cut.split(text)])

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary_text(path: str) -> str:
    """The tokenizer file as text. It is read where the plan is made and travels with the
    tasks, so executors need no copy; its size is that of one vocabulary (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _on_column(df: DataFrame, spec: str, column: str, out: str, kind: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(spec)
    made = pa.binary() if kind == "binary" else pa.string()
    loaded: list[Vocabulary] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(Vocabulary(shipped.value))
        fn = loaded[0].encode if kind == "binary" else loaded[0].decode
        values = [None if v is None else fn(v) for v in
                  batch.column(batch.schema.get_field_index(column)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, made)],
                                          names=[*batch.schema.names, out])

    return map_slices(df, run, fields(*df.schema.fields, f"`{out}` {kind}"))


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids``: the token ids of every whole text.

    ``spec`` is the text of a byte-level BPE file in the tokenizers library's JSON form.
    ``ids`` packs them as little-endian unsigned 32-bit integers. Special tokens written in a
    text become their ids. A null text counts as empty and gives no ids; null keys and repeated
    rows are kept; other columns are not read; an empty table gives no rows. Nothing is
    shuffled; a task holds one slice of texts and a bounded memory of words.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    coded = _on_column(rows, spec, "text", "ids", "binary")
    return coded.select(F.col("key").alias(key),
                        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids")


def decode(coded: DataFrame, spec: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, ids, text`` of packed ids, special tokens written out; null ids give null.

    Ids outside the vocabulary raise an error; bytes that are no UTF-8 become U+FFFD."""
    rows = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return _on_column(rows, spec, "ids", "text", "string").select(
        F.col("key").alias(key), F.col("ids").alias(ids), "text")
