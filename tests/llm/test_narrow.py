"""URL filters, language, quality rules, BPE, chats and licenses on hand-made rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrain.llm import (bpe, chat_format, language_id, license_scan, quality_rules, queries,
                            url_filter)
from tests.llm.conftest import HARD_TEXTS

SF = "/root/testdata/sf0.001"


# ---- URL filters --------------------------------------------------------------------------
def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://X.Example.ORG/es/1",
        "https://example.org/es/?q=://b.com/fr/", "http://example.org/en/1", "http://notexample.org/en/1",
        "http://a.example.com/fr/2#x", "http://a.com/de/", "ftp://com/de/x", "http://a.com?x/de/",
        "http://a..org//", "http://a.org:80/", "http://user@b.org/es/", "a://b://c.org/", "http://a.org/",
        "x" * 5000 + "://a.b.c.d.org/" + "y" * 5000]


def test_url_filter(spark):
    rules = queries.URL_RULES + [("a.org", "/", "block"), ("a.org", "/", "allow")]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(None, URLS[5], "x", "y")],
                                  "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()
    want = {i: brute_verdict(u, rules) for i, u in enumerate(URLS)} | {None: brute_verdict(URLS[5], rules)}
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert [(r.rule, r.verdict) for r in url_filter.url_filter(pages, none).collect()] == [(None, "allow")]
    assert url_filter.url_filter(pages.limit(0), none).collect() == []


# ---- language -----------------------------------------------------------------------------
def test_language_accuracy_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op2(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_hard_rows(docs):
    table = docs([(i, t, None, None) for i, t in enumerate(HARD_TEXTS)] + [(None, "12 34 --")])
    model = {"aa": b"same text here and there " * 20, "bb": b"qwx zzv kkj " * 20}
    got = {r.doc_id: r for r in language_id.classify(table, model).collect()}
    assert len(got) == len(HARD_TEXTS) + 1
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[None].lang_pred == "und"
    assert got[0].score == 0 and got[0].rejected
    assert got[8].lang_pred == "aa" and got[8].score == got[9].score and not got[8].rejected
    assert {r.lang_pred for r in language_id.classify(table, {}).collect()} == {"und"}
    assert language_id.fit(table) == {}
    assert language_id.classify(table.limit(0), model).count() == 0
    lone = language_id.classify(table, {"aa": model["aa"]}).collect()
    assert {r.lang_pred for r in lone} == {"aa", "und"}


def test_language_fit_is_bounded_and_ignores_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = language_id.fit(docs, sample_docs=5, sample_chars=100)
    assert one == language_id.fit(docs.orderBy(F.desc("doc_id")), sample_docs=5, sample_chars=100)
    assert all(len(v.decode()) <= 5 * 101 for v in one.values())
    assert len(language_id.fit(docs, max_languages=2)) == 2


def test_language_fit_counts_copies_once(spark):
    word = lambda i: "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(12))
    rows = [(t, "xx") for t in {f"{word(i)} {word(i + 5)} text" for i in range(20)} | {"one passage"}]
    once = spark.createDataFrame(rows, "text string, lang string")
    copied = [("one passage", "xx"), ("One  passage 12!", "xx")] * 2000
    many = once.unionByName(spark.createDataFrame(copied, once.schema)).repartition(5)
    for docs in (5, 64):  # the passage takes one slot at most, whatever its hash
        assert language_id.fit(many, sample_docs=docs) == language_id.fit(once, sample_docs=docs)
    pieces = language_id.fit(many)["xx"].decode().split("\n")
    assert len(pieces) == len(set(pieces)) == len(rows)


def test_language_fit_takes_whole_pieces(spark):
    # few letters among many digits: a place drawn from the raw length lies behind the letters
    rows = [(f"{'7' * 900} start {chr(97 + i) * 30} end {'7' * 900}", "xx") for i in range(26)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample_chars=20)
    assert [len(p) for p in model["xx"].decode().split("\n")] == [20] * 26


# ---- quality ------------------------------------------------------------------------------
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(covered), sum(c.isupper() for c in text),
            sum(any(c.isalpha() for c in w) for w in words))


def test_quality_measures(docs):
    texts = HARD_TEXTS + ["a b c d e a b c d e", "a b c d e f a b c d e", "l\nl\n\n \nl\nm",
                          "## $5 a|b <x>", "a a a a a a", "ÀÉ bc D"]
    got = {r.doc_id: r for r in quality_rules.ledger(docs([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][m] for m in quality_rules.MEASURES) == brute_quality(text), text
    assert quality_rules.ledger(docs([])).collect() == []


def test_quality_policy_and_ablations(docs):
    good = " ".join(f"word{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(60)).replace("x", "e")
    table = docs([(1, good), (2, None), (3, good.replace(" ", "### ")), (4, good.upper()), (None, good)])
    rows = quality_rules.apply_policy(quality_rules.ledger(table), "v1")
    assert {r.doc_id: r.kept for r in rows.collect()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert {r.doc_id: r.kept for r in quality_rules.apply_policy(quality_rules.ledger(table), "base").collect()}[3]
    losses = {(r["policy"], r["rule"]): (r.n_failed, r.n_only) for r in quality_rules.ablations(rows).collect()}
    assert losses["v1", "capitals"] == (1, 1) and losses["v1", "symbols"] == (1, 1)
    assert losses["base", "few_words"] == (1, 1)


# ---- BPE ----------------------------------------------------------------------------------
def test_bpe_equals_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = HARD_TEXTS + ["a<|endoftext|>b <|endoftext|>", "it's we'll  double  space\n\n tab\t.", "ab" * 900,
                          "\x85\xa0\u3000x\u200b\x1c\x1d y\u2028z", "😀👍🏽 e\u0301", "١٢٣ ½ Ⅷ x²", "\x00\x01",
                          "".join(map(chr, range(1, 0x250)))]
    spec = bpe.vocabulary_text(path)
    coded = bpe.encode(docs([(i, t) for i, t in enumerate(texts)]), spec)
    back = {r.doc_id: r for r in bpe.decode(coded, spec).collect()}
    counts = {r.doc_id: r.n_tokens for r in coded.collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(back[i].ids, "<u4").tolist() == ids, repr(text)
        assert back[i].text == (text or "") and counts[i] == len(ids)
    assert bpe.encode(docs([]), spec).collect() == []


def test_bpe_long_words_merge_alike():
    import public_tokenizers
    vocab = bpe.Vocabulary(bpe.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")))
    for word in ["a" * 300, "ab" * 400, "the" * 99 + "zq" * 50, "1234567890" * 30]:
        ids = [vocab.first[b] for b in word.encode()]
        assert vocab._short(list(ids)) == vocab._long(list(ids))


# ---- chats --------------------------------------------------------------------------------
CONTROLS = ["<|turn|>", "<\\|end|>", "<\\\\|x", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "\\", "<", "[\\INST]"]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", c + " text " + c) for c in CONTROLS[:1]]
    rows += [(2, i, ("user", "assistant")[i // 2 % 2], c) for i, c in enumerate(CONTROLS * 3)]
    rows += [(3, None, None, None), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"),
             (None, 5, "assistant", "lost\n"), (4, 1, "assistant", "one"), (4, 2, "assistant", ""),
             (4, 3, "a<|body|>\nb", "<|part|>")]
    df = spark.createDataFrame([r + ("clash",) for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.format_chats(df).select(
        "conv_id", "formatted", "segments", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("segments")).alias("loss")).collect()
    assert {r.conv_id for r in got} == {1, 2, 3, 4, None}
    for r in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    merged = next(r for r in got if r.conv_id == 4).formatted
    assert merged.count(chat_format.TURN) == 2 and merged.count(chat_format.PART) == 1
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_chat_query_has_the_probe(spark):
    row = {r.conv_id: r for r in queries.op9(spark, SF).collect()}[-1]
    text = queries.INJECTION
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- licenses -----------------------------------------------------------------------------
def brute_phrases(text):
    words = re.findall(license_scan.TOKEN, "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = sorted((label, i) for phrase, label in license_scan.PHRASES
                    for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    return len(words), places


LICENSED = [
    ("Released under the MIT License.", {"mit"}), ("under the mit license under the MIT license", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
    ("licensed under the terms of the GNU General Public License as published by the Free Software "
     "Foundation; either version 2 of", {"gpl-2"}),
    ("licensed under the GNU Public License version 3", set()), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2"}), ("apache license version", set()),
    ("Copyright (c) 2020 Some Person. All rights reserved.", {"all-rights-reserved"}),
    ("copyright a b c d e f g h i j all rights reserved", set()), ("licensed under the new 3 BSD 3-clause license", {"bsd"}),
    ("apache apache license version 2", {"apache-2"}), ("cc by cc by nc", {"cc-by-nc"}),
]


def test_license_scan(docs):
    texts = HARD_TEXTS + [t for t, _ in LICENSED]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        n, places = brute_phrases(text)
        assert got[i].n_words == n and [(s.label, s.first) for s in got[i].phrase_spans] == places
    for i, (text, labels) in enumerate(LICENSED, len(HARD_TEXTS)):
        spans = [*got[i].phrase_spans, *got[i].template_spans]
        assert {s.label for s in spans} == labels, text
    assert license_scan.scan_licenses(docs([])).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
   following disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAME = """3. Neither the name of the University of Example nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written permission.
"""
BSD_ADVERT = """3. All advertising materials mentioning features or use of this software must display the following
   acknowledgement: This product includes software developed by the organization.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU %sGeneral
Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %sGeneral Public License for
more details."""
WHOLE = [
    (MIT, {"mit", "mit-opening"}),
    (MIT.replace("\nTHE SOFTWARE IS", "\nThe Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS"), {"mit-opening"}),
    (MIT.replace(", subject to the following conditions:", ".").replace(
        MIT[MIT.index("The above"):MIT.index("THE SOFTWARE IS")], ""), {"mit-opening"}),
    (BSD % "", {"bsd-2", "bsd-opening"}), (BSD % BSD_NAME, {"bsd-3", "bsd-opening"}),
    (BSD % (BSD_ADVERT + BSD_NAME.replace("3.", "4.")), {"bsd-opening"}),
    ((BSD % BSD_NAME).replace("must retain", "may drop"), {"bsd-opening"}),
    (APACHE, {"apache-2", "apache-2-notice"}), (APACHE.replace("may not use", "may use"), {"apache-2"}),
    (GPL % ("", "2", ""), {"gpl-2-notice"}), (GPL % ("", "3", ""), {"gpl-3-notice"}),
    (GPL % ("Lesser ", "2.1", "Lesser "), {"lgpl-notice"}), (GPL % ("Lesser ", "3", ""), set()),
    ("Copyright (c) 1998, 1999, 2000, 2001, 2003-2010, 2012 The Example Project and Others. All rights reserved.",
     {"all-rights-reserved"}),
    ("Copyright © 2020 One Two Three Four Five Six Seven Eight Nine. All rights reserved.", {"all-rights-reserved"}),
]


def test_license_altered_after_its_first_sentence(docs):
    found = license_scan.scan_licenses(docs([(i, t) for i, (t, _) in enumerate(WHOLE)])).collect()
    got = {r.doc_id: {s.label for s in [*r.phrase_spans, *r.template_spans]} for r in found}
    assert [got[i] for i in range(len(WHOLE))] == [labels for _, labels in WHOLE]


def test_license_base_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10(spark, SF).collect():
        n, places = brute_phrases(texts[r.doc_id])
        starts = [i for _, i in places]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for x, _ in places})))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_markup_errors():
    for bad in ("[[ open", "closed ]]", "{{3}} first"):
        with pytest.raises(ValueError):
            license_scan.Automaton([("x", bad)])


def test_language_keys_stay_in_the_jvm(spark, capsys):
    """Keys may be whole rows; only the text goes to Python."""
    from claimgrain.llm import language_id
    table = spark.createDataFrame([(1, "some words", "x" * 50)], "doc_id long, text string, wide string")
    language_id.classify(table.selectExpr("struct(*) AS row", "text"), {"aa": b"some words"}, key="row").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
