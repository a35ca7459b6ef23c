"""Licence scan: sparse TF-IDF cosine of statements to templates, then inheritance down directories.

DataFrame operations throughout.

* A statement is a sentence or line, anywhere in a text, with a licence word in it; the whole text of a
  licence file (by its name) is a statement too.  Distinct statements are scored once.
* Terms are runs of ASCII letters and digits, inner dots and hyphens included; weights are term
  frequency times ln((1 + N) / (1 + df)) + 1 over the N templates.  A statement's licence is the template
  of the greatest cosine, if that is at least ``COSINE``; of equals the first by name.
* A template only counts where all its ``needed`` terms stand (those with a digit, and the names of licences) and
  where the ``MARKS`` (words that tell a licence from its kin) are just its own: another version or variant is
  another licence.
* Statements without a licence, and paragraphs of several lines with a licence word, are held against
  ``HEADERS`` (file headers, SPDX lines, openings of licence texts): the best run of as many terms as
  the template has counts, so that a header inside a longer text is found.  Every run is looked at:
  its product with the template and a lower bound of its norm (each term counted for itself) are
  differences of running sums, and only runs that could reach ``COSINE`` are counted term by term.
* The opening that the BSD licences share tells the family ``BSD``, not which of them.
* A file's own licence is that of its best statement.  A file without one takes that of the nearest
  directory above it (its own first) that holds a licence file with a licence; of several licence files
  in a directory the first path counts.

Terms in some template, counts, paths and hashes are shuffled.  The terms of a statement itself move only
for statements that hold enough of a template.  Templates are a parameter with a bounded number
of terms, stand in the plan as values, and are broadcast.

Defined results: null or empty texts have no statement but may inherit; a null path has no directory
and inherits nothing; repeated rows each get a row; equal texts have equal licences.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

COSINE = 0.6
# The usual notices of public licences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("All-rights-reserved", "All rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
_GNU = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_SPDX = {"AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache-2.0": ("Apache-2.0",), "BSD-2-Clause": ("BSD-2-Clause",),
         "BSD-3-Clause": ("BSD-3-Clause",),
         "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC0-1.0": ("CC0-1.0",),
         "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
         "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "MIT": ("MIT",), "MPL-2.0": ("MPL-2.0",)}
# Usual file headers, SPDX lines and openings of licence texts.
HEADERS = (
    *((name, f"SPDX-License-Identifier: {x}") for name, ids in _SPDX.items() for x in ids),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at"),
)
# Names of licences, and words that tell one from its kin.
NAMES = ("affero", "apache", "attribution", "cc", "commons", "gnu", "lesser", "mit", "mozilla", "spdx-license-identifier")
MARKS = ("affero", "attribution-noncommercial", "attribution-noncommercial-noderivatives", "attribution-noncommercial-sharealike",
         "attribution-noderivatives", "attribution-sharealike", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "lesser", "library")
TRIGGER = r"(?i)licen[cs]e|copyright|rights reserved|public domain|permission is hereby|redistribution and use|released under"
SENTENCE_END = r"[.!?]\s+|\n"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
PARAGRAPH_END = r"\n[ \t\r]*\n"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[._-][^/]*)?$"


def needed(bag) -> set[str]:
    """Terms of a template without which a text is not its licence: those with a digit, names and marks."""
    return {t for t in bag if t in NAMES or t in MARKS or re.search("[0-9]", t)}


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float]], float]:
    """(template number, licence, term, unit-length weight times idf) for the terms of all templates, and the
    idf of a term in none."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(t for b in bags for t in b)
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((f * idf[t]) ** 2 for t, f in bag.items()))
        rows += [(k, name, t, f * idf[t] * idf[t] / norm) for t, f in sorted(bag.items())]
    return rows, math.log(1 + n) + 1


def template_idf(templates=TEMPLATES) -> list[tuple[str, float]]:
    bags = [set(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(t for b in bags for t in b)
    return sorted((t, math.log((1 + len(bags)) / (1 + d)) + 1) for t, d in df.items())


def template_table(templates=TEMPLATES) -> list[tuple[int, str, int, int, str]]:
    """(template number, licence, terms, distinct needed terms, marks)."""
    out = []
    for k, (name, text) in enumerate(templates):
        terms = re.findall(TERM, text.lower())
        out.append((k, name, len(terms), len(needed(terms)), " ".join(sorted({t for t in terms if t in MARKS}))))
    return out


def _inline(spark: SparkSession, names: str, rows) -> DataFrame:
    """A small table of values that stands in the plan, broadcast."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t({names})"))


def _terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _tables(spark: SparkSession, templates) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Weights (template, term, weight, share, need), idf (term, idf), templates (template, license, size, needs, marks),
    and the idf of a term in none.  ``share`` is the part of a template's squared length that a term makes up."""
    weights, unseen = template_weights(templates)
    idf = dict(template_idf(templates))
    need = [needed(re.findall(TERM, text.lower())) for _, text in templates]
    w = _inline(spark, "template, term, weight, share, need", [(k, t, x, (x / idf[t]) ** 2, int(t in need[k])) for k, _, t, x in weights])
    return w, _inline(spark, "term, idf", sorted(idf.items())), _inline(spark, "template, license, size, needs, marks", template_table(templates)), unseen


def _scores(counts: DataFrame, by: list[str], tables, cosine: float) -> DataFrame:
    """Best (sid, license, score) from term counts (by..., term, f); ``by`` begins with sid, and may hold the template."""
    w, idf, about, unseen = tables
    held = F.when(F.col("term").isin(*MARKS), F.col("term"))
    norms = (counts.join(idf, "term", "left").groupBy(*by)
             .agg(F.sqrt(F.sum(F.pow(F.col("f") * F.coalesce("idf", F.lit(unseen)), 2))).alias("norm"),
                  F.array_join(F.sort_array(F.collect_set(held)), " ").alias("held")))
    keys = by if "template" in by else [*by, "template"]
    dots = (counts.join(w, ["template", "term"] if "template" in by else "term").groupBy(*keys)
            .agg(F.sum(F.col("f") * F.col("weight")).alias("dot"), F.sum("need").alias("have")))
    scored = (dots.join(norms, by).join(about, "template").where((F.col("have") == F.col("needs")) & (F.col("held") == F.col("marks")))
              .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= cosine))
    best = scored.groupBy("sid").agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("license"))).alias("b"))
    return best.select("sid", F.col("b.license").alias("license"), (-F.col("b.m")).alias("score"))


def score_statements(statements: DataFrame, templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """``statements`` (sid, statement) that match a template: sid, license, score.  Terms travel with the
    short ``sid``, which must tell statements apart, and never with the text."""
    # Copies of a statement are counted each for itself, and all but one dropped by sid.
    terms = (statements.withColumn("copy", F.monotonically_increasing_id())
             .select("sid", "copy", F.explode(_terms_of(F.col("statement"))).alias("term"))
             .groupBy("sid", "copy", "term").agg(F.count("*").alias("f")).dropDuplicates(["sid", "term"]).drop("copy"))
    return _scores(terms, ["sid"], _tables(statements.sparkSession, templates), cosine)


def score_runs(statements: DataFrame, templates=HEADERS, cosine: float = COSINE) -> DataFrame:
    """``statements`` (sid, statement) of which some run of as many terms as a template has matches it: sid,
    license, score of the best run.  A shorter statement is one run."""
    tables = _tables(statements.sparkSession, templates)
    w, idf, about, unseen = tables
    units = statements.select("sid", _terms_of(F.col("statement")).alias("terms"))
    # A run's cosine is at most the root of the template's squared length that it shares, and so is the statement's.
    known = sorted({t for _, text in templates for t in re.findall(TERM, text.lower())})
    present = (units.select("sid", F.explode(F.array_intersect("terms", F.array(*[F.lit(t) for t in known]))).alias("term"))
               .dropDuplicates(["sid", "term"]))
    likely = (present.join(w, "term").groupBy("sid", "template").agg(F.sum("share").alias("share"), F.sum("need").alias("have"))
              .join(about, "template").where((F.col("share") >= cosine * cosine - 1e-9) & (F.col("have") == F.col("needs")))
              .select("sid", "template", "size", "needs"))
    likely = cut_lineage(likely, "license-likely")
    texts = cut_lineage(units.join(likely.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "license-terms")

    cells = (texts.join(likely, "sid").select("sid", "template", "needs", F.least("size", F.size("terms")).alias("m"), F.posexplode("terms").alias("pos", "term"))
             .join(w.select("template", "term", "weight", "need"), ["template", "term"], "left").join(idf, "term", "left"))
    upto = Window.partitionBy("sid", "template").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.select("sid", "template", "needs", "m", "pos", F.sum(F.coalesce("weight", F.lit(0.0))).over(upto).alias("dot"),
                           F.sum(F.pow(F.coalesce("idf", F.lit(unseen)), 2)).over(upto).alias("square"),
                           F.sum(F.coalesce("need", F.lit(0))).over(upto).alias("have"))
    # Every running sum ends a run, and is what another run, ``m`` later, began with.
    both = F.array(F.struct(F.col("pos").alias("end"), F.col("dot"), F.col("square"), F.col("have"), F.lit(1).alias("ends")),
                   F.struct((F.col("pos") + F.col("m")).alias("end"), (-F.col("dot")).alias("dot"), (-F.col("square")).alias("square"),
                            (-F.col("have")).alias("have"), F.lit(0).alias("ends")))
    runs = (running.select("sid", "template", "needs", "m", F.inline(both)).groupBy("sid", "template", "needs", "m", "end")
            .agg(*[F.sum(c).alias(c) for c in ("dot", "square", "have", "ends")])
            .where((F.col("ends") == 1) & (F.col("end") >= F.col("m") - 1) & (F.col("have") >= F.col("needs"))
                   & (F.col("dot") >= (cosine - 1e-6) * F.sqrt(F.greatest("square", F.lit(0.0)))))
            .select("sid", "template", "m", (F.col("end") - F.col("m") + 1).alias("run")))
    counted = (texts.join(runs, "sid").select("sid", "template", "run", F.explode(F.slice("terms", F.col("run") + 1, F.col("m"))).alias("term"))
               .groupBy("sid", "template", "run", "term").agg(F.count("*").alias("f")))
    return _scores(cut_lineage(counted, "license-runs"), ["sid", "template", "run"], tables, cosine)


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/+$", "")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None,
                  templates=TEMPLATES, cosine: float = COSINE, headers=HEADERS) -> DataFrame:
    """``files`` (columns ``keep``, by default all but the text) with ``own_license``, ``own_score``, ``license`` and
    ``inherited_from`` (the directory, null if the licence is the file's own or there is none)."""
    new = {path, "own_license", "own_score", "license", "inherited_from"}
    kept = [c for c in (keep if keep is not None else [c for c in files.columns if c != text]) if c not in new]
    t, p = F.col(f"`{text}`"), F.col(f"`{path}`").cast("string")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    special = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    parts = F.filter(F.split(t, SENTENCE_END, -1), lambda s: s.rlike(TRIGGER))
    none = F.array().cast("array<string>")
    said = F.when(t.rlike(TRIGGER), parts).otherwise(none)
    whole = F.when(special & (t != ""), F.array(t)).otherwise(none)
    lines = F.filter(F.split(t, PARAGRAPH_END, -1), lambda s: s.rlike(TRIGGER) & s.contains("\n"))
    paragraphs = F.when(t.rlike(TRIGGER) & ~special, lines).otherwise(none)
    table = cut_lineage(files.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], p.alias("path"), special.alias("special"),
        F.array_distinct(F.concat(said, whole)).alias("statements"), F.array_distinct(paragraphs).alias("paragraphs"),
        F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(31), t).alias("b"), F.length(t).alias("n"), special.alias("s")).alias("key")),
        "license-statements")
    sid = F.struct(F.xxhash64("statement").alias("a"), F.xxhash64(F.lit(37), "statement").alias("b"), F.length("statement").alias("n"))
    stated = table.where(F.size("statements") > 0).select("key", F.explode("statements").alias("statement")).withColumn("sid", sid)
    scored = cut_lineage(score_statements(stated, templates, cosine), "license-scores")
    if headers:
        lines = table.where(F.size("paragraphs") > 0).select("key", F.explode("paragraphs").alias("statement")).withColumn("sid", sid)
        left = stated.join(scored, "sid", "left_anti").unionByName(lines)
        scored = scored.unionByName(score_runs(left, headers, cosine))
        stated = stated.unionByName(lines)
    own = (stated.select("key", "sid").distinct().join(scored, "sid").groupBy("key")
           .agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("license"))).alias("b"))
           .select("key", F.col("b.license").alias("own_license"), (-F.col("b.m")).alias("own_score")))
    found = (table.drop("statements", "paragraphs").withColumn("folder", F.when(F.col("path").isNotNull(), _folder(F.col("path"))))
             .join(own, "key", "left"))
    holders = (found.where("special and own_license is not null and folder is not null").groupBy("folder")
               .agg(F.min(F.struct("path", "own_license")).alias("b"))
               .select(F.col("folder").alias("above"), F.col("b.own_license").alias("folder_license")))
    parts = F.split("folder", "/", -1)
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    nearest = (table.select(_folder(F.col("path")).alias("folder")).where("folder is not null").distinct()
               .select("folder", F.posexplode(F.array_distinct(above)).alias("depth", "above")).join(holders, "above")
               .groupBy("folder").agg(F.max(F.struct("depth", "above", "folder_license")).alias("b"))
               .select("folder", F.col("b.above").alias("holder"), F.col("b.folder_license").alias("folder_license")))
    out = found.join(nearest, "folder", "left")
    inherits = F.col("own_license").isNull()
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("path").alias(path), "own_license", "own_score",
                      F.coalesce("own_license", "folder_license").alias("license"),
                      F.when(inherits, F.col("holder")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files ``source/thousand/lang/id.txt``.

    A document with a licence word in its last line is a licence file of that directory,
    ``LICENSE-id.txt``; one with a licence word in its first line is one of ``source/thousand``.
    """
    first, last = (F.coalesce(F.substring_index("text", "\n", n).rlike(TRIGGER), F.lit(False)) for n in (1, -1))
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    file = F.concat(F.when(first | last, F.lit("LICENSE-")).otherwise(""), text_of(F.col("doc_id")), F.lit(".txt"))
    # concat_ws leaves out a null language folder.
    path = F.concat_ws("/", text_of(F.col("source")), text_of(F.expr("doc_id div 1000")),
                       F.when(~first, text_of(F.col("lang"))), file)
    return docs.select("doc_id", path.alias("path"), "text")


def license_table(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, path, own_license, own_score, license, inherited_from."""
    return scan_licenses(document_paths(docs))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)
                                     for x in r) + ")" for r in rows)


def oracle_sql() -> str:
    """The same result in DuckDB SQL: every run of every statement, counted term by term."""
    weights, unseen = template_weights()
    head, head_unseen = template_weights(HEADERS)
    trigger = TRIGGER[4:]
    marks = "[" + ", ".join(f"'{m}'" for m in MARKS) + "]"
    needs = [(k, "'" + "|".join(sorted(needed(re.findall(TERM, text.lower())))) + "'") for t in (TEMPLATES, HEADERS)
             for k, (_, text) in enumerate(t, 0 if t is TEMPLATES else 1000)]
    about = [(k, name, size, marks_of) for t, add in ((TEMPLATES, 0), (HEADERS, 1000)) for k, name, size, _, marks_of in
             ((k + add, *rest) for k, *rest in template_table(t))]
    every = [(k, t, x) for k, _, t, x in weights] + [(k + 1000, t, x) for k, _, t, x in head]
    return f"""
WITH w(template, term, weight) AS (VALUES {_values(every)}),
idf(headers, term, idf) AS (VALUES {_values([(0, *r) for r in template_idf()] + [(1, *r) for r in template_idf(HEADERS)])}),
about(template, license, size, marks) AS (VALUES {_values(about)}),
need AS (SELECT template, list_filter(string_split(terms, '|'), lambda x: x <> '') AS needs FROM (VALUES {", ".join(f"({k}, {t})" for k, t in needs)}) n(template, terms)),
files AS (
  SELECT doc_id, text, r, coalesce(source, 'none') || '/' || coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none')
           || CASE WHEN first THEN '' ELSE '/' || coalesce(lang, 'none') END AS folder,
         (CASE WHEN first OR last THEN 'LICENSE-' ELSE '' END) || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' AS name
  FROM (SELECT *, row_number() OVER () AS r, coalesce(regexp_matches(split_part(text, chr(10), 1), '{trigger}', 'i'), false) AS first,
               coalesce(regexp_matches(split_part(text, chr(10), -1), '{trigger}', 'i'), false) AS last FROM documents)
), units AS (
  SELECT DISTINCT r, statement FROM (
    SELECT r, unnest(list_filter(string_split_regex(text, '[.!?]\\s+|\\n'), lambda s: regexp_matches(s, '{trigger}', 'i'))) AS statement FROM files
    UNION ALL SELECT r, text FROM files WHERE name LIKE 'LICENSE%' AND text <> '')
), paragraphs AS (
  SELECT DISTINCT r, statement FROM (SELECT r, unnest(list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'),
    lambda s: regexp_matches(s, '{trigger}', 'i') AND contains(s, chr(10)))) AS statement FROM files WHERE name NOT LIKE 'LICENSE%')
), split AS (
  SELECT statement, regexp_extract_all(lower(statement), '{TERM}') AS terms FROM (SELECT statement FROM units UNION SELECT statement FROM paragraphs)
), whole AS (
  SELECT statement, template, license, terms AS run FROM split JOIN about ON template < 1000
  JOIN need USING (template) WHERE list_has_all(terms, needs) AND statement IN (SELECT statement FROM units)
), scored_whole AS (
  SELECT statement, license, max(score) AS score FROM (
    SELECT statement, template, license, round(sum(f * coalesce(weight, 0)) / sqrt(sum(power(f * coalesce(idf, {unseen!r}), 2))), 6) AS score
    FROM (SELECT statement, template, license, term, count(*) AS f FROM (SELECT statement, template, license, unnest(run) AS term FROM whole
          WHERE array_to_string(list_sort(list_distinct(list_filter(run, lambda x: list_contains({marks}, x)))), ' ') = (SELECT marks FROM about a WHERE a.template = whole.template)) GROUP BY ALL)
    LEFT JOIN w USING (template, term) LEFT JOIN (SELECT term, idf FROM idf WHERE headers = 0) USING (term) GROUP BY ALL)
  WHERE score >= {COSINE} GROUP BY ALL
), remaining AS (
  SELECT statement FROM units WHERE statement NOT IN (SELECT statement FROM scored_whole) UNION SELECT statement FROM paragraphs
), runs AS (
  SELECT statement, template, license, marks, i, terms[i:i + size - 1] AS run FROM (
    SELECT statement, template, license, marks, size, needs, terms, unnest(range(1, greatest(len(terms) - size, 0) + 2)) AS i
    FROM split JOIN remaining USING (statement), about JOIN need USING (template) WHERE template >= 1000 AND list_has_all(terms, needs))
  WHERE list_has_all(terms[i:i + size - 1], needs)
), scored_runs AS (
  SELECT statement, license, max(score) AS score FROM (
    SELECT statement, template, i, license, round(sum(f * coalesce(weight, 0)) / sqrt(sum(power(f * coalesce(idf, {head_unseen!r}), 2))), 6) AS score
    FROM (SELECT statement, template, license, i, term, count(*) AS f FROM (SELECT statement, template, license, i, unnest(run) AS term FROM runs
          WHERE array_to_string(list_sort(list_distinct(list_filter(run, lambda x: list_contains({marks}, x)))), ' ') = marks) GROUP BY ALL)
    LEFT JOIN w USING (template, term) LEFT JOIN (SELECT term, idf FROM idf WHERE headers = 1) USING (term) GROUP BY ALL)
  WHERE score >= {COSINE} GROUP BY ALL
), own AS (
  SELECT r, license AS own_license, score AS own_score FROM (
    SELECT r, license, score FROM units JOIN scored_whole USING (statement)
    UNION ALL SELECT r, license, score FROM (SELECT * FROM units WHERE statement NOT IN (SELECT statement FROM scored_whole) UNION SELECT * FROM paragraphs)
      JOIN scored_runs USING (statement))
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1
), found AS (SELECT * FROM files LEFT JOIN own USING (r)), holders AS (
  SELECT folder, arg_min(own_license, name) AS folder_license FROM found
  WHERE name LIKE 'LICENSE%' AND own_license IS NOT NULL GROUP BY 1
), nearest AS (
  SELECT f.folder, h.folder AS holder, h.folder_license FROM (SELECT DISTINCT folder FROM files) f
  JOIN holders h ON starts_with(f.folder || '/', h.folder || '/')
  QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(h.folder) DESC) = 1
)
SELECT doc_id, found.folder || '/' || name AS path, own_license, own_score, coalesce(own_license, folder_license) AS license,
       CASE WHEN own_license IS NULL THEN holder END AS inherited_from
FROM found LEFT JOIN nearest ON nearest.folder = found.folder
"""
