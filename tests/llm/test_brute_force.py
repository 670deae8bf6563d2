"""Languages, tokens and licenses against plain code of another kind, over whole tables."""

import hashlib
import re

import numpy as np
import regex
import zstandard
from pyspark.sql import functions as F

from claimgrain.llm import language_id, license_scan, queries, url_filter
from tests.llm.conftest import HARD_TEXTS
from tests.llm.test_narrow import LICENSED, WHOLE

SF = "/root/testdata/sf0.001"


def texts_of(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_language(text, model):
    """Smallest compressed size over the languages' dictionaries, with compressors of one use each."""
    if not text or not regex.search(r"\p{L}", text):
        return language_id.UNKNOWN, 0.0
    data = regex.sub(r"\P{L}+", " ", text).lower().encode()
    sizes = []
    for name, content in model.items():
        total = 0
        for at in range(0, len(data), language_id.BLOCK):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(content), strategy=language_id.STRATEGY,
                min_match=language_id.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            shared.precompute_compress(compression_params=settings)
            total += len(zstandard.ZstdCompressor(dict_data=shared, compression_params=settings).compress(
                data[at:at + language_id.BLOCK]))
        sizes.append((total, name))
    best, second = sorted(sizes)[:2]
    return best[1], 1.0 - best[0] / second[0]


def test_language_equals_plain_compression(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(table.filter(~queries.held_out("doc_id")))
    got = {r.doc_id: r for r in queries.op2(spark, SF).collect()}
    for i, text in list(texts_of(spark).items())[::2]:
        assert (got[i].lang_pred, got[i].score) == plain_language(text, model)
        assert got[i].rejected == (got[i].score < language_id.MARGIN or got[i].lang_pred == "und")
    odd = language_id.classify(docs(list(enumerate(HARD_TEXTS))), model).collect()
    for r in odd:
        assert (r.lang_pred, r.score) == plain_language(HARD_TEXTS[r.doc_id], model)


def test_fit_of_a_share_equals_the_whole_pass(spark, monkeypatch):
    """A hashed share of the texts gives the same sample as all of them where copies are few."""
    rows = [(f"word{i} text number {'abcdefgh'[i % 8] * (i % 9)} of kind {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "xx")
            for i in range(5000)] + [("all the same", "xx")] * 4000 + [("few", "yy"), ("texts", "yy")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    few = language_id.fit(df, sample_docs=16)
    assert set(few) == {"xx", "yy"} and len(few["xx"].split(b"\n")) == 16 and len(few["yy"].split(b"\n")) == 2
    copies = spark.createDataFrame([("only one text", "xx")] * 3000 + [(f"rare {c}", "xx") for c in "abcdefghijklmnop"], df.schema)
    assert len(language_id.fit(copies, sample_docs=16)["xx"].split(b"\n")) == 16  # found by the whole pass


def test_tokens_of_the_whole_table_equal_the_library(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation()
    plain.no_padding()
    texts = texts_of(spark)
    got = queries.op4(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def template_pattern(steps):
    out = ""
    for step in steps:
        if isinstance(step, str):
            out += re.escape(step) + " "
        elif step is license_scan.NUMBERS:
            out += "(?:[0-9]+ )*"
        elif isinstance(step, int):
            out += "(?:[^ ]+ ){0,%d}" % step
        else:
            out += "(?:" + "|".join(map(template_pattern, step)) + ")?"
    return out


PATTERNS = [(label, re.compile(template_pattern(license_scan.parse(t)))) for label, t in license_scan.TEMPLATES]


def plain_templates(text):
    """Shortest match of every template at every word, by regular expressions."""
    words = re.findall(license_scan.TOKEN, "".join(c.lower() if c.isascii() else c for c in text or ""))
    best = {}
    for start in range(len(words)):
        rest = " ".join(words[start:start + 600]) + " "
        for label, pattern in PATTERNS:
            if pattern.match(rest):
                end = next(e for e in range(start + 1, len(words) + 1) if pattern.fullmatch(" ".join(words[start:e]) + " "))
                best[label, start] = min(end, best.get((label, start), end))
    return sorted((label, start, end - 1) for (label, start), end in best.items())


TAGGED = [
    ("// SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"), ("spdx license identifier ISC", "isc"), ("SPDX-License-Identifier: CC0-1.0", "cc0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2-notice"),
    ("Licensed under the Mozilla Public License, version 2.0", "mpl-2"),
    ("licensed under the terms of the GNU Affero General Public License, version 3", "agpl-3"),
    ("Licensed under the ISC license.", "isc"), ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY 4.0", "cc-by"), ("licensed under CC BY-SA 4.0", "cc-by-sa"), ("Released under CC0", "cc0"), ("released under the CC0", "cc0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 license", "cc-by-sa"), ("CC0 1.0 Universal", "cc0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("mozilla public license", None),
]


def test_templates_equal_regular_expressions(spark, docs):
    rows = [t for t, _ in [*LICENSED, *WHOLE, *TAGGED]]
    rows += [" junk ".join(rows[i::7]) for i in range(7)] + HARD_TEXTS[:4] + HARD_TEXTS[7:]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(list(enumerate(rows)))).collect()}
    for i, text in enumerate(rows):
        assert [(s.label, s.first, s.last) for s in got[i].template_spans] == plain_templates(text), text
    for i, (text, label) in enumerate(TAGGED, len(LICENSED) + len(WHOLE)):
        labels = {s.label for s in got[i].template_spans}
        assert (label in labels) if label else not labels, (text, labels)


def test_templates_over_the_whole_table(spark):
    texts = texts_of(spark)
    found = license_scan.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    for r in found:
        assert [(s.label, s.first, s.last) for s in r.template_spans] == plain_templates(texts[r.doc_id])


def test_license_scores(docs):
    rows = ["under the mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the software without restriction", "copyright 2020 x all rights reserved", "nothing", None]
    scan = license_scan.scan_licenses(docs(list(enumerate(rows))))
    got = {r.doc_id: r.s for r in scan.select("doc_id", license_scan.strength(F.col("phrase_spans"), F.col("template_spans")).alias("s")).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0}


def test_a_host_of_many_labels_costs_its_length(spark):
    """100,000 labels: only suffixes of as many labels as rules have are made."""
    host = ".".join(["a"] * 100_000) + ".example.org"
    pages = spark.createDataFrame([(1, f"https://{host}/en/1x"), (2, "https://org/"), (3, "https://b.c.d.com/fr/")], "page_id int, url string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("d.com", "/", "block"), ("x.y.z.c.d.com", "/", "allow")], url_filter.RULE_SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("com/fr/", "allow")}
