"""License scans: license templates compiled to token automata and run over whole texts.

A template is wording with markup: ``[[ ... ]]`` is optional, ``{{n}}`` stands for up to n
words of anything (names), ``{{#}}`` for any count of numbers (years). Everything else is mandatory and has to match word by word.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrain.llm.common import fields, lower_ascii, map_slices

#: Fixed value: words are runs of letters and digits (ASCII) and of all other characters.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# ---- fixed values: the phrases every scan looks for, and their labels ---------------------
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# ---- fixed values: license notices, with optional and replaceable regions -----------------
_MIT_GRANT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of "
    "this software and associated documentation files [[(the \"software\")]], to deal in "
    "the software without restriction")
_MIT_REST = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the software, and to permit persons to whom the software is "
    "furnished to do so, subject to the following conditions: the above copyright notice and this "
    "permission notice [[(including the next paragraph)]] shall be included in all copies or "
    "substantial portions of the software. the software is provided \"as is\", without warranty of "
    "any kind, express or implied, including but not limited to the warranties of merchantability, "
    "fitness for a particular purpose and noninfringement. in no event shall {{12}} be liable for "
    "any claim, damages or other liability, whether in an action of contract, tort or otherwise, "
    "arising from, out of or in connection with the software or the use or other dealings in the "
    "software")
_ISC_GRANT = (
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted")
_ISC_REST = (
    ", provided that the above copyright notice and this permission notice appear in all copies. the "
    "software is provided \"as is\" and {{6}} disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness. in no event shall {{6}} be liable "
    "for any special, direct, indirect, or consequential damages or any damages whatsoever resulting "
    "from loss of use, data or profits, whether in an action of contract, negligence or other tortious "
    "action, arising out of or in connection with the use or performance of this software")
_BSD_GRANT = (
    "redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met")
_BSD_1_2 = (
    ": [[1 | a | i]] redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. [[2 | b | ii]] redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = (
    "[[3 | c | iii]] neither the name of {{12}} nor the names of [[its | their | the]] contributors "
    "may be used to endorse or promote products derived from this software without specific prior "
    "written permission. ")
_BSD_DISCLAIMER = (
    "this software is provided by {{12}} \"as is\" and any express or implied warranties, including, "
    "but not limited to, the implied warranties of merchantability and fitness for a particular "
    "purpose are disclaimed. in no event shall {{12}} be liable for any direct, indirect, "
    "incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business "
    "interruption) however caused and on any theory of liability, whether in contract, strict "
    "liability, or tort (including negligence or otherwise) arising in any way out of the use of "
    "this software, even if advised of the possibility of such damage")


def _gnu_notice(name: str, version: str) -> str:
    return (f"free software you can redistribute it and/or modify it under the terms of the {name} "
            f"[[version {version} [[only]]]] as published by the free software foundation [[; [[either]] "
            f"version {version} of the license [[, or (at your option) any later version]]]]. {{{{6}}}} "
            "is distributed in the hope that it will be useful, but without any warranty; without "
            "even the implied warranty of merchantability or fitness for a particular purpose. see "
            f"the {name} for more details")


#: Identifiers of ``SPDX-License-Identifier`` tags, as words, and their labels.
_TAGGED = {
    "mit": "mit", "apache 2.0": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc",
    "gpl 2.0": "gpl-2", "gpl 3.0": "gpl-3", "lgpl 2.1": "lgpl", "lgpl 3.0": "lgpl", "agpl 3.0": "agpl-3",
    "mpl 2.0": "mpl-2", "cc0 1.0": "cc0", "cc by 4.0": "cc-by", "cc by sa 4.0": "cc-by-sa", "cc by nc 4.0": "cc-by-nc",
    "unlicense": "unlicense",
}

#: Whole license texts are ``mit``, ``bsd-2``, ``bsd-3`` and ``isc``, whole notices ``...-notice``. A
#: text that goes on otherwise after the first sentence of a license is an ``...-opening`` only.
#: The other labels are statements and tags that name a license.
TEMPLATES = [
    ("mit", "[[this software is | this work is | this project is]] released under the mit "
            "[[ / x11]] license"),
    ("mit", _MIT_GRANT + _MIT_REST),
    ("mit-opening", _MIT_GRANT),
    ("apache-2", "licensed under the apache license [[,]] version 2 [[.0]]"),
    ("apache-2-notice",
     "licensed under the apache license, version 2.0 [[(the \"license\")]]; you may not use this "
     "[[file | software | work | project]] except in compliance with the license. you may obtain a "
     "copy of the license at [[http | https]] www.apache.org/licenses/license-2.0 [[txt | html]] "
     "unless required by applicable law or agreed to in writing, software distributed under the "
     "license is distributed on an \"as is\" basis, without warranties or conditions of any kind, "
     "either express or implied. see the license for the specific language governing permissions "
     "and limitations under the license"),
    ("gpl-2", "[[this work is]] licensed under the [[terms of the]] gnu general public license "
              "[[as published by the free software foundation]] [[; either]] version 2"),
    ("gpl-2-notice", _gnu_notice("gnu general public license", "2")),
    ("gpl-3", "[[this work is]] licensed under the [[terms of the]] gnu general public license "
              "[[as published by the free software foundation]] [[; either]] version 3"),
    ("gpl-3-notice", _gnu_notice("gnu general public license", "3")),
    ("lgpl", "licensed under the [[terms of the]] gnu lesser general public license"),
    ("lgpl-notice", _gnu_notice("gnu lesser general public license", "2.1")),
    ("lgpl-notice", _gnu_notice("gnu lesser general public license", "3")),
    ("bsd-2", _BSD_GRANT + _BSD_1_2 + _BSD_DISCLAIMER),
    ("bsd-3", _BSD_GRANT + _BSD_1_2 + _BSD_3 + _BSD_DISCLAIMER),
    ("bsd-opening", _BSD_GRANT),
    ("bsd", "licensed under the [[{{2}}]] bsd [[2 clause | 3 clause]] license"),
    ("cc-by-nc", "licensed under [[a | the]] [[creative commons]] cc by nc"),
    ("cc-by-nc", "licensed under [[a | the]] creative commons attribution non commercial "
                 "[[4.0]] [[international]] license"),
    ("all-rights-reserved", "copyright [[c | ©]] {{#}} {{9}} {{#}} all rights reserved"),
    ("mpl-2-notice",
     "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of "
     "the mpl was not distributed with this file, you can obtain one at [[http | https]] "
     "mozilla.org/mpl/2.0"),
    ("mpl-2", "licensed under the [[terms of the]] mozilla public license [[,]] [[v | version]] 2.0"),
    ("agpl-3", "[[this work is]] licensed under the [[terms of the]] gnu affero general public license "
               "[[as published by the free software foundation]] [[; either]] version 3"),
    ("agpl-3-notice", _gnu_notice("gnu affero general public license", "3")),
    ("isc", _ISC_GRANT + _ISC_REST),
    ("isc-opening", _ISC_GRANT),
    ("isc", "[[licensed | released]] under the isc license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "[[licensed | released]] under [[a | the]] [[creative commons]] cc0"),
    ("cc0", "cc0 1.0 universal"),
    ("cc-by", "licensed under [[a | the]] [[creative commons]] cc by {{#}} [[international]] license"),
    ("cc-by", "licensed under [[a | the]] cc by 4.0"),
    ("cc-by", "licensed under [[a | the]] creative commons attribution {{#}} [[international]] license"),
    ("cc-by-sa", "licensed under [[a | the]] [[creative commons]] cc by sa"),
    ("cc-by-sa", "licensed under [[a | the]] creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under [[a | the]] creative commons attribution share alike"),
    *((label, f"spdx license identifier: {words}") for words, label in _TAGGED.items()),
]


#: Step for any count of numbers.
NUMBERS = object()


def template_words(text: str) -> list[str]:
    return regex.findall(TOKEN, text.lower())


def parse(template: str) -> list:
    """Markup to steps: a word, an int n (up to n words of anything), ``NUMBERS``, or a list of
    alternatives of an optional region, each a list of steps."""
    def steps(pieces: list[str]) -> list:
        out: list = []
        while pieces and pieces[0] not in ("]]", "|"):
            piece = pieces.pop(0)
            if piece == "[[":
                ways = [steps(pieces)]
                while pieces and pieces[0] == "|":
                    pieces.pop(0)
                    ways.append(steps(pieces))
                if not pieces:
                    raise ValueError(f"unclosed [[ in: {template}")
                pieces.pop(0)
                out.append([w for w in ways if w])
            elif piece == "{{#}}":
                out.append(NUMBERS)
            elif piece.startswith("{{"):
                out.append(int(piece[2:-2]))
            else:
                out += template_words(piece)
        return out

    pieces = [p for p in regex.split(r"(\[\[|\]\]|\||\{\{(?:\d+|#)\}\})", template) if p.strip()]
    out = steps(pieces)
    if pieces:
        raise ValueError(f"unopened ]] or | in: {template}")
    return out


class Automaton:
    """All templates as one nondeterministic automaton over words.

    ``edges[state]`` maps a word to next states, ``anything[state]`` are next states for any
    word, states of ``numbers`` stay where they are on a number, and ``free[state]`` are states reached without a word. Optional regions are bypassed
    by free edges; a region of n words is n states in a row, each with a free way out.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.edges: list[dict[str, set[int]]] = []
        self.anything: list[set[int]] = []
        self.free: list[set[int]] = []
        self.numbers: set[int] = set()
        self.accepts: dict[int, str] = {}
        starts = []
        for label, text in templates:
            begin = self._state()
            starts.append(begin)
            end = self._add(begin, parse(text))
            self.accepts[end] = label
        self.starts = self._closed(starts)
        if any(s in self.accepts or self.anything[s] or s in self.numbers for s in self.starts):
            raise ValueError("a template needs a mandatory word before any free one")
        #: word -> states after it, from any start: texts without these words are left alone
        self.openers: dict[str, frozenset[int]] = {}
        for word in {w for s in self.starts for w in self.edges[s]}:
            self.openers[word] = self._step(self.starts, word)

    def _state(self) -> int:
        self.edges.append({})
        self.anything.append(set())
        self.free.append(set())
        return len(self.edges) - 1

    def _add(self, state: int, steps: list) -> int:
        for step in steps:
            after = self._state()
            if isinstance(step, str):
                self.edges[state].setdefault(step, set()).add(after)
            elif step is NUMBERS:
                self.free[state].add(after)
                self.numbers.add(after)
            elif isinstance(step, int):
                at = state
                for _ in range(step):
                    self.free[at].add(after)
                    more = self._state()
                    self.anything[at].add(more)
                    at = more
                self.free[at].add(after)
            else:
                self.free[state].add(after)
                for way in step:
                    self.free[self._add(state, way)].add(after)
            state = after
        return state

    def _closed(self, states) -> frozenset[int]:
        seen, rest = set(states), list(states)
        while rest:
            for s in self.free[rest.pop()]:
                if s not in seen:
                    seen.add(s)
                    rest.append(s)
        return frozenset(seen)

    def _step(self, states, word: str) -> frozenset[int]:
        after: set[int] = set()
        for s in states:
            after |= self.anything[s]
            after |= self.edges[s].get(word, set())
            if s in self.numbers and word.isdigit():
                after.add(s)
        return self._closed(after)

    def scan(self, words: list[str]) -> list[tuple[str, int, int]]:
        """``(label, start, end)`` word spans of every accepted template, shortest match per
        start and label."""
        found: set[tuple[str, int, int]] = set()
        open_runs: dict[int, frozenset[int]] = {}
        openers = self.openers
        for at, word in enumerate(words):
            runs = {}
            for start, states in open_runs.items():
                if after := self._step(states, word):
                    runs[start] = after
            if word in openers:
                runs[at] = openers[word]
            for start, states in list(runs.items()):
                for s in states:
                    if s in self.accepts:
                        found.add((self.accepts[s], start, at + 1))
            open_runs = runs
        best: dict[tuple[str, int], int] = {}
        for label, start, end in found:
            best[label, start] = min(end, best.get((label, start), end))
        return sorted((label, start, end) for (label, start), end in best.items())


def _phrase_places(words: list[str], phrases: list[tuple[list[str], str]]) -> list[tuple[str, int, int]]:
    out, n = [], len(words)
    for parts, label in phrases:
        first, size, at = parts[0], len(parts), -1
        try:
            while True:
                at = words.index(first, at + 1)
                if at + size <= n and words[at:at + size] == parts:
                    out.append((label, at, at + size))
        except ValueError:
            pass
    return out


SPAN = "array<struct<label:string,first:bigint,last:bigint>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: list[tuple[str, str]] | None = None,
                  phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """``key, n_words, phrase_spans, template_spans`` of every whole text.

    Spans ``(label, first, last)`` are word places, both ends included, from 0, sorted. Base
    phrases match where their words stand consecutively; templates match where all mandatory
    wording does. Case of A-Z does not count. A null or empty text has no words and empty
    spans; null keys and repeated rows are kept; other columns are not read; an empty table
    gives no rows. Nothing is shuffled. Words are counted in the JVM; only texts that hold the
    first word of a phrase or an opening word of a template are cut into words in Python, the
    others cannot match.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    # the rarest mandatory words of each template, as plain substrings: none of them, no match
    needles = sorted({_anchor(t) for _, t in [*templates, *((b, a) for a, b in phrases)]})
    lowered = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("key"), lowered.alias("text"))
    worth: Column = reduce(lambda a, b: a | b, [F.col("text").contains(n) for n in needles],
                           F.lit(False))
    rows = rows.select("key", F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("n_words"),
                       F.when(worth, F.col("text")).alias("text"))
    cut = [(template_words(p), label) for p, label in phrases]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, words = Automaton(templates), regex.compile(TOKEN)
        plain, formed = [], []
        for value in batch.column(2).to_pylist():
            tokens = words.findall(value) if value else []
            for spans, out in ((sorted(_phrase_places(tokens, cut)), plain),
                               (automaton.scan(tokens), formed)):
                out.append([{"label": a, "first": b, "last": c - 1} for a, b, c in spans])
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(plain, kind), pa.array(formed, kind)],
            names=["key", "n_words", "phrase_spans", "template_spans"])

    found = map_slices(rows, run, fields(
        rows.schema["key"], f"n_words long, phrase_spans {SPAN}, template_spans {SPAN}"))
    return found.withColumnRenamed("key", key)


#: Words so common in prose that a text holding one is no hint of a license.
_COMMON = {"is", "to", "of", "the", "a", "by", "this", "under", "and", "in", "any", "with", "or",
           "use", "all", "are", "that", "without", "free", "nc"}


def _anchor(template: str) -> str:
    """The longest mandatory word, which every matching text must hold."""
    mandatory = [w for w in parse(template) if isinstance(w, str)]
    return max(mandatory, key=lambda w: (w not in _COMMON, len(w)))


def strength(phrase_spans: Column, template_spans: Column) -> Column:
    """How firmly a text names a license, 0 to 1: 1 for base phrases, tags, statements, whole notices
    and whole licenses, 0.5 where only an opening or a reservation of rights was found, else 0."""
    weak = F.forall(template_spans, lambda s: s["label"].endswith("-opening")
                    | (s["label"] == "all-rights-reserved"))
    return (F.when((F.size(phrase_spans) > 0) | ~weak, 1.0)
            .when(F.size(template_spans) > 0, 0.5).otherwise(0.0))


def labels_of(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["label"]))
