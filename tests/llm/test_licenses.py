import math
import random
import re
from collections import Counter

import duckdb
import pytest

from leadtime.llm import licenses as L

TEXT = "path string, text string, license string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "old") for r in rows], TEXT)
    return {r.path: (r.own_license, r.license, r.inherited_from) for r in L.scan_licenses(df, keep=["license"], **kw).collect()}


@pytest.mark.parametrize("name,text", L.TEMPLATES)
def test_every_template_is_found_in_a_header(spark, name, text):
    got = run(spark, [("a/b.txt", f"Some words. \n{text}.\nand more text")])
    assert got["a/b.txt"][:2] == (name, name)


def test_nearest_ancestor_wins(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3"
    got = run(spark, [("LICENSE", mit), ("x/COPYING.txt", gpl), ("x/y/z/f.txt", "nothing"), ("x2/f.txt", None), ("f.txt", ""),
                      ("x/g.txt", mit), ("licensed/f.txt", "the word license alone")])
    assert got["x/y/z/f.txt"] == (None, "GPL-3.0", "x") and got["x2/f.txt"] == (None, "MIT", "") and got["f.txt"] == (None, "MIT", "")
    assert got["x/g.txt"] == ("MIT", "MIT", None) and got["licensed/f.txt"][1] == "MIT"


def test_ties_nulls_repeats_and_empty(spark, odd_docs, no_docs):
    got = run(spark, [("d/LICENSE-b", "Released under the MIT License"), ("d/LICENSE-a", "All rights reserved"), ("d/f", "x")])
    assert got["d/f"] == (None, "All-rights-reserved", "d")
    rows = [(None, "Released under the MIT License", "k"), (None, None, None), ("a/b", None, "k"), ("a/b", None, "k"), ("/r/f", "x " * 50000, "k")]
    out = L.scan_licenses(spark.createDataFrame(rows, TEXT)).collect()
    assert len(out) == 5 and sorted(str(r.license) for r in out) == ["MIT", "None", "None", "None", "None"]
    assert L.license_table(odd_docs).count() == 10 and L.license_table(no_docs).count() == 0


def test_similar_licences_are_told_apart(spark):
    got = run(spark, [("a", "Licensed under CC BY-SA 4.0."), ("b", "This work is licensed under the GNU General Public License, version 2."),
                      ("c", "a long sentence that only mentions a license once among many many other words of no meaning at all")])
    assert got["a"][0] == "CC-BY-SA-4.0" and got["b"][0] == "GPL-2.0" and got["c"][0] is None


APACHE = """/*
 * Copyright 2020 The Authors
 *
 * Licensed to the Foundation under one or more contributor license agreements; see the
 * NOTICE file.  The Foundation licenses this file to You under the Apache License, Version
 * 2.0 (the "License"); you may not use this file except in compliance with the
 * License.  You may obtain a copy of the License at the address below.
 */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""


def test_usual_headers_and_licence_files(spark):
    want = {
        "mit.c": ("// SPDX-License-Identifier: MIT", "MIT"), "apache.py": ("# SPDX-License-Identifier: Apache-2.0\nx = 1", "Apache-2.0"),
        "gpl.h": ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), "zlib.c": ("// SPDX-License-Identifier: Zlib", None),
        "one.txt": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "Apache-2.0"),
        "wrapped.java": (APACHE + "\n\nclass X {}", "Apache-2.0"),
        "g3.py": (GPL.format("", 3) + "\n\nimport os", "GPL-3.0"), "g2.py": (GPL.format("", 2) + "\n\nimport os", "GPL-2.0"),
        "l3.py": (GPL.format("Lesser ", 3), "LGPL-3.0"), "a3.py": (GPL.format("Affero ", 3), "AGPL-3.0"),
        "p/LICENSE": ("                                 Apache License\n                           Version 2.0, January 2004\n"
                      "                        http://www.apache.org/licenses/\n\n" + "some clause of many words that goes on and on " * 200, "Apache-2.0"),
        "q/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "everyone is permitted to copy and distribute " * 300, "GPL-3.0"),
        "prose.txt": ("A driving license is\nneeded for this, and a copyright notice\nmay be put on the door.", None),
    }
    got = run(spark, [(k, t) for k, (t, _) in want.items()])
    assert {k: v[0] for k, v in got.items()} == {k: x for k, (_, x) in want.items()}
    before = run(spark, [(k, t) for k, (t, _) in want.items()], headers=())
    assert [k for k in want if before[k][0] != want[k][1]]


def test_kin_of_a_licence_is_not_the_licence(spark):
    want = {
        "a": ("copyright und das Haus mit Licht", None), "b": ("not released under the GPL-3.0 / license at all", None),
        "c": ("Licensed under CC BY 3.0.", None), "d": (GPL.format("Lesser ", "2.1"), None),
        "e": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following\nconditions are met", "BSD"),
        "f": ("Mozilla Public License Version 1.1", None), "g": ("Copyright\nein Absatz mit Lizenz und mit Worten", None),
        "h": ("Licensed under CC BY-NC-SA 4.0.", None), "i": ("Library terms: GNU Library General Public License, version 2 of the\nLicense", None),
        "j": ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), "k": ("// SPDX-License-Identifier: GPL-2.0+", "GPL-2.0"),
    }
    got = run(spark, [(k, t) for k, (t, _) in want.items()])
    assert {k: v[0] for k, v in got.items()} == {k: x for k, (_, x) in want.items()}


def slow_runs(text, templates=L.HEADERS):
    """Best (licence, score) over every run of every template, counted term by term."""
    weights, unseen = L.template_weights(templates)
    idf, terms = dict(L.template_idf(templates)), re.findall(L.TERM, text.lower())
    best = None
    for k, (name, t) in enumerate(templates):
        own = re.findall(L.TERM, t.lower())
        w = {x: v for j, _, x, v in weights if j == k}
        for i in range(max(len(terms) - len(own), 0) + 1):
            part = Counter(terms[i:i + len(own)])
            if not part or not L.needed(own) <= set(part) or {x for x in part if x in L.MARKS} != {x for x in own if x in L.MARKS}:
                continue
            norm = math.sqrt(sum((f * idf.get(x, unseen)) ** 2 for x, f in part.items()))
            score = round(sum(f * w.get(x, 0.0) for x, f in part.items()) / norm, 6)
            if score >= L.COSINE and (best is None or (-score, name) < (-best[1], best[0])):
                best = (name, score)
    return best


def test_best_run_equals_brute_force(spark):
    rng = random.Random(6)
    words = "the of any license copyright version 2.0 3 may not use this gnu general public apache file mit with or licensed under 2 lesser".split()
    texts = []
    for _ in range(60):
        t = " ".join(rng.choices(words, k=rng.randrange(1, 60)))
        name, header = rng.choice(L.HEADERS)
        bits = header.split()
        for _ in range(rng.randrange(4)):
            bits[rng.randrange(len(bits))] = rng.choice(words)
        texts.append(f"{t} {' '.join(bits)} {t}")
    texts += [texts[0], "license " * 3000 + L.HEADERS[-1][1] + " word" * 3000, "copyright"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sid int, statement string")
    got = {r.sid: (r.license, r.score) for r in L.score_runs(df).collect()}
    want = {i: slow_runs(t) for i, t in enumerate(texts[:-2])}
    want[len(texts) - 2] = ("MPL-2.0", 1.0)
    assert {i: v for i, v in want.items() if v} == got and len(got) > 20


def test_copies_of_a_statement_are_counted_once(spark):
    text = "Released under the MIT License"
    df = spark.createDataFrame([(i % 2, text + " the" * (i % 2)) for i in range(40)], "sid int, statement string").repartition(4)
    one = {r.sid: r.score for r in L.score_statements(df.where("sid = 0").limit(1)).collect()}
    got = {r.sid: r.score for r in L.score_statements(df).collect()}
    assert got[0] == one[0] == 1.0 and 0.6 < got[1] < 1


def test_query_equals_sql_and_has_no_python(spark, sf):
    from leadtime.llm.catalog import ORACLE, QUERIES
    out = QUERIES["op1_license_scan"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = ["doc_id", "path", "own_license", "own_score", "license", "inherited_from"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op1_license_scan']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.select(cols).collect())
