import re
import time

import pytest

from sensorfill.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, rules):
    words = words_of(text)
    line = " " + " ".join(words) + " "
    base = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    found = set()
    for label, _, pattern, priority in rules:
        for m in re.finditer(pattern, line):
            start = line[: m.start()].count(" ")
            found.add((start, start + m.group().count(" "), priority, label))
    order = lambda d: (-d[2], d[3])
    outer = [
        d for d in found
        if not any(
            o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or order(o) < order(d)) for o in found
        )
    ]
    kept = []
    for d in sorted(outer):
        if kept and d[0] < kept[-1][1]:
            if d[2] > kept[-1][2]:
                kept[-1] = d
        else:
            kept.append(d)
    return len(words), sorted(base), kept


TEXTS = [
    "SPDX-License-Identifier: GPL-2.0-only\nLicensed under the Apache License, Version 2.0. MIT LICENSE mit license MIT",
    "cc by cc by-nc-sa 4.0, Creative Commons Attribution-ShareAlike 3.0; copyright (c) 2019 all rights reserved",
    "GNU General Public License version 3 or later; BSD 3-Clause License; mozilla public license 2.0",
    "released under the terms of the GNU Lesser General Public License v2.1, dedicated to the public domain",
    "mit K license, mİt license, MITlicense, the gnu  general\npublic--license",
    "mit license " * 40,
    "Distributed under CC BY-NC 4.0. Licensed under CC BY 4.0. licensed under the gnu general public license",
    "nothing here", "", None, " ... ",
]


def test_there_are_hundreds_of_rules():
    rules = L.rules()
    assert len(rules) > 300
    assert all(pattern[0] == " " and pattern.endswith("(?= )") for _, _, pattern, _ in rules)


@pytest.mark.parametrize("part", [0, 1])
def test_against_brute_force(spark, part):
    docs = spark.createDataFrame(list(enumerate(TEXTS[part::2])), "doc_id long, text string")
    rules = L.rules()
    for r in L.with_licenses(docs).collect():
        n, base, kept = brute(TEXTS[part::2][r.doc_id], rules)
        assert r.n_words == n
        assert [tuple(x) for x in r.base] == base
        assert [tuple(x) for x in r.detections] == kept


def test_query(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in L.op9_licenses(spark, str(tmp_path)).collect()}
    assert rows[0].base_labels == "apache,mit" and rows[0].labels == "apache,apache-2.0,gpl-2.0,mit"
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word) == (40, 0, 78)
    assert rows[9].n_words == 0 and rows[9].first_word is None and rows[9].labels == ""
    for r in rows.values():
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_no_python_in_the_plan(spark, odd_docs, no_docs):
    found = L.with_licenses(odd_docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert found.count() == 10 and L.with_licenses(no_docs).count() == 0


def matches_of(pattern):
    """Strings that a rule's pattern matches: each alternative, each option with and without."""
    def ways(node):
        kind, arg = str(node[0]), node[1]
        if kind == "LITERAL":
            return [chr(arg)]
        if kind == "IN":
            # Letters of a class, or one digit.
            return [chr(x[1]) for x in arg if str(x[0]) == "LITERAL"] or ["7"]
        if kind == "BRANCH":
            return [w for part in arg[1] for w in several(part)]
        if kind == "SUBPATTERN":
            return several(arg[3])
        if kind == "MAX_REPEAT":
            assert tuple(arg[:2]) == (0, 1)
            return ["", *several(arg[2])]
        assert kind == "ASSERT"
        return [" "]

    def several(nodes):
        out = [""]
        for node in nodes:
            out = [a + b for a in out for b in ways(node)]
        return out

    return several(re._parser.parse(pattern))


def test_what_a_rule_matches_has_its_keyword_and_a_gate():
    for label, key, pattern, _ in L.rules():
        for text in matches_of(pattern):
            assert re.search(pattern, text)
            assert key in text, (label, key, text)
            assert any(gate in text for gate in L.GATES), (label, text)


# What each text must be labelled; the others are words that are no licence.
FOUND = {
    "GFDL 1.3": "gfdl-1.3",
    "gfdl": "gfdl",
    "the zlib/libpng License": "zlib",
    "PSF License": "python",
    "PSF license version 2": "python-2.0",
    "PSF-2.0": "python-2.0",
    "GPLv2": "gpl-2.0",
    "GPL2 and gpl v. 3": "gpl-2.0,gpl-3.0",
    "LGPLv2.1+": "lgpl-2.1",
    "AGPLv3, MPLv2.0": "agpl-3.0,mpl-2.0",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: Python-2.0": "python-2.0",
    "licensed under the MIT": "mit",
    "BSL-1.0 OFL-1.1 ODbL-1.0 CDDL-1.0": "boost-1.0,cddl-1.0,odbl-1.0,ofl-1.1",
    "MS-PL, Artistic-2.0": "artistic-2.0,ms-pl",
    "MIT, an isc meeting, python 2.0, php 3.0, apache2 and the zlib": "",
}


def test_names_without_a_common_keyword_and_short_forms(spark):
    texts = list(FOUND)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.with_licenses(docs).collect():
        assert ",".join(sorted({d.label for d in r.detections})) == FOUND[texts[r.doc_id]], texts[r.doc_id]
        assert [tuple(x) for x in r.detections] == brute(texts[r.doc_id], L.rules())[2]


def test_many_detections_in_one_text_against_brute_force(spark):
    # Several blocks of the walk, with intervals that overlap across their borders.
    text = "licensed under the gnu general public license version 3 or later mit license apache license 2.0 of it " * 60
    text += "mit license cc by nc sa 4.0 " * 60
    row = L.with_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    n, base, kept = brute(text, L.rules())
    assert row.n_words == n and len(kept) > 250
    assert sorted((x.start, x.label) for x in row.base) == base
    assert [(x.start, x.end, x.priority, x.label) for x in row.detections] == kept


def test_a_text_of_many_phrases_takes_time_in_proportion(spark):
    times = []
    for n in (2_000, 10_000, 40_000):
        docs = spark.createDataFrame([(1, "the mit license of it. " * n)], "doc_id long, text string")
        start = time.perf_counter()
        row = L.with_licenses(docs).head()
        times.append(time.perf_counter() - start)
        assert len(row.base) == n and len(row.detections) == n
    # Four times the text; a quadratic walk takes sixteen times as long.
    assert times[2] < 9 * max(times[1], 1)


def test_columns_with_the_names_made_on_the_way(spark):
    docs = spark.createDataFrame(
        [(1, "mit license", "a", "b", "c", 9)],
        "doc_id long, text string, _words string, row string, low string, n_words int",
    )
    out = L.with_licenses(docs)
    assert out.columns == ["doc_id", "text", "_words", "row", "low", "n_words", "base", "detections"]
    row = out.head()
    assert (row._words, row.row, row.low, row.n_words) == ("a", "b", "c", 2)
