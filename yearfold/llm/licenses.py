"""License scans: lines, headers and licence files against templates, and inheritance along directories.

Three kinds of units of each text are compared with templates of their kind by the cosine of
sparse TF-IDF vectors: lines with statements, paragraphs of several lines with file headers, and
whole texts with whole licences. Every unit takes part; those are left out that cannot reach the
threshold, because too few of their words are in any template of the kind. Each different unit is
compared once. A document without a licence of its own takes that of the nearest directory above
it that has a licence file. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, looked_up, prepare, table

FILE_SHARE = 0.05
THRESHOLDS = {"line": 0.6, "block": 0.7, "whole": 0.8}
LEAST_SHARED = 2
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.-]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"\n[^A-Za-z0-9\n]*\n"
# Short statements of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution CC BY 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is granted under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain, see the Unlicense"),
    ("Apache-2.0", "Apache 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "License: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GPL 3.0"),
    ("GPL-2.0", "GPL 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
)
# First paragraphs of the headers that licences give for files.
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)


def whole_licenses() -> tuple[tuple[str, str], ...]:
    """(name, text) of each whole licence, from the files beside this module."""
    return tuple((p.name[: -len(".txt")], p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


@lru_cache(maxsize=1)
def templates() -> dict[str, tuple[tuple[str, str], ...]]:
    """(license, text) of each template, by kind."""
    return {"line": TEMPLATES, "block": HEADERS, "whole": whole_licenses()}


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weights(kind: str) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Template rows (number, license, word, share of the unit vector), the rarity of each word, and that of a word in no template.

    A word weighs the root of its count times its rarity, 1 + ln((1 + templates) / (1 + templates with it)).
    """
    counts = [Counter(words(text)) for _, text in templates()[kind]]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for t, ((name, _), c) in enumerate(zip(templates()[kind], counts, strict=True)):
        norm = math.sqrt(sum(n * idf[w] ** 2 for w, n in c.items()))
        rows += [(t, name, w, math.sqrt(n) * idf[w] / norm) for w, n in c.items()]
    return rows, idf, math.log(1 + len(counts)) + 1


def tokens(c: str) -> str:
    return f"transform(filter(split({c}, '[^A-Za-z0-9]+'), w -> w <> ''), w -> lower(w))"


def vocabulary(*kinds: str) -> str:
    """SQL for the words of templates of these kinds, for IN."""
    return "(" + ", ".join(f"'{w}'" for w in sorted({w for k in kinds for _, text in templates()[k] for w in words(text)})) + ")"


def reachable(kind: str, found: str) -> str:
    """SQL for whether a text whose words in templates are `found` may hold a unit that reaches the kind's threshold.

    A cosine is at most the length of the template's unit vector over the words that both have. So
    for some template, the squared weights of its words in the text must add up to the square.
    """
    rows: dict[int, list[str]] = {}
    for t, _, w, tw in weights(kind)[0]:
        rows.setdefault(t, []).append(f"named_struct('w', '{w}', 'x', {tw * tw!r}D)")
    every = "array(" + ", ".join(f"array({', '.join(r)})" for r in rows.values()) + ")"
    return f"exists({every}, t -> aggregate(t, 0D, (a, p) -> a + CASE WHEN array_contains({found}, p.w) THEN p.x ELSE 0D END) >= {(THRESHOLDS[kind] - 1e-6) ** 2!r}D)"


def likely(units: str, kind: str) -> str:
    """SQL for the units of an array that may reach the kind's threshold.

    A word in no template weighs most. So the square of a cosine is at most the share of the
    unit's words, repeats included, that are in some template: what is below cannot match.
    """
    share = (THRESHOLDS[kind] - 1e-6) ** 2
    return f"filter({units}, u -> {let(tokens('u'), 'ws', f'size(filter(ws, w -> w IN {vocabulary(kind)})) >= greatest({LEAST_SHARED}, {share!r}D * size(ws))')})"


def matched(units: DataFrame, kind: str) -> DataFrame:
    """(kind, text, license, cosine) of the different units (text) that reach the threshold and share two words; equal cosines go to the first name."""
    spark = units.sparkSession
    rows, idf, unknown = weights(kind)
    t = spark.createDataFrame(rows, "t int, license string, w string, tw double")  # these two: some thousand rows, fixed above
    rare = spark.createDataFrame(list(idf.items()), "w string, idf double")
    u = units.distinct().withColumn("u", F.sha2(F.encode("text", "UTF-8"), 256)).checkpoint()
    v = u.select("u", F.explode(F.expr(tokens("text"))).alias("w")).groupBy("u", "w").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(rare), "w", "left")
    v = v.select("u", "w", (F.sqrt("tf") * F.coalesce("idf", F.lit(unknown))).alias("uw")).checkpoint()
    norm = v.groupBy("u").agg(F.sqrt(F.sum(F.col("uw") * F.col("uw"))).alias("norm"))
    dot = v.join(F.broadcast(t), "w").groupBy("u", "t", "license").agg(F.sum(F.col("uw") * F.col("tw")).alias("dot"), F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    cos = dot.join(norm, "u").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= THRESHOLDS[kind])
    best = cos.groupBy("u").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return u.join(best, "u").select(F.lit(kind).alias("kind"), "text", "b.license", (-F.col("b.c")).alias("cosine"))


def parent(c):
    return F.regexp_replace(c, "/?[^/]*$", "")


def scan(df: DataFrame, path, doc_id: str = "doc_id", text: str = "text", licence_file=None) -> DataFrame:
    """(doc_id, path, license, origin, cosine, from_dir) of every row.

    path: a column with / between its parts. origin is own, inherited or none; license, cosine
    and from_dir are null where there is none (from_dir unless inherited). A whole licence counts
    before the best line, header or SPDX line. A licence file, by default a row that is a whole
    licence or whose matching lines make FILE_SHARE of its text, speaks for its directory; of
    several licences there the most frequent one does, then the first name. Null and empty texts
    have no units, a null path no directory. Repeated rows stay; an empty table gives an empty result.
    """
    prepare(df.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), path.alias("path"), F.length(t).alias("size"), t.alias("t"))
    spdx, lines, nothing = f"u RLIKE r'{SPDX}'", r"split(t, r'\n', -1)", "CAST(array() AS ARRAY<STRING>)"
    several = f"filter(split(t, r'{GAP}', -1), u -> contains(trim('\n' FROM u), '\n'))"
    # a text's words that are in templates, once; from them, whether lines, paragraphs or all of it can match
    docs = docs.withColumn("low", F.translate("t", UPPER, UPPER.lower()))
    docs = docs.withColumn("known", F.expr(let("split(low, '[^a-z0-9]+')", "ws", f"named_struct('n', size(ws) - 2, 'k', filter(ws, w -> w IN {vocabulary(*THRESHOLDS)}))")))
    docs = docs.withColumns({"found": F.array_distinct("known.k"), "shared": F.expr(f"size(filter(known.k, w -> w IN {vocabulary('whole')}))")})
    docs = docs.withColumns({k: F.expr(reachable(k, "found")) for k in ("line", "block")}).withColumn("whole", F.expr(f"shared >= greatest({LEAST_SHARED}, {(THRESHOLDS['whole'] - 1e-6) ** 2!r}D * known.n)"))
    units = {
        "spdx": f"CASE WHEN contains(low, 'spdx-license-identifier:') THEN filter({lines}, u -> {spdx}) ELSE {nothing} END",
        "line": f"CASE WHEN line THEN filter({likely(lines, 'line')}, u -> NOT {spdx}) ELSE {nothing} END",
        "block": f"CASE WHEN block THEN {likely(several, 'block')} ELSE {nothing} END",
        "whole": f"CASE WHEN whole THEN {likely('array(t)', 'whole')} ELSE {nothing} END",
    }
    every = ", ".join(f"transform({u}, x -> named_struct('kind', '{k}', 'text', x))" for k, u in units.items())
    docs = docs.withColumn("units", F.expr(f"concat({every})"))
    docs = docs.select("doc_id", "path", "size", "units", F.when(F.size("units") > 0, F.sha2(F.encode("t", "UTF-8"), 256)).alias("h")).checkpoint()
    silent = docs.where(F.size("units") == 0).select("doc_id", "path", *[F.lit(None).cast(k).alias(c) for c, k in (("license", "string"), ("cosine", "double"), ("share", "double"))])
    each = docs.where(F.size("units") > 0).select("doc_id", "path", "size", "h", F.posexplode("units").alias("pos", "unit")).select("doc_id", "path", "size", "h", "pos", "unit.*").checkpoint()
    hits = [matched(each.where(F.col("kind") == k).select("text"), k) for k in THRESHOLDS]
    told = F.regexp_replace(F.regexp_extract("text", SPDX, 1), "(?i)-(only|or-later)$", "")
    hits = hits[0].union(hits[1]).union(hits[2]).union(each.where("kind = 'spdx'").select("kind", "text").distinct().select("kind", "text", told, F.lit(1.0))).checkpoint()
    of = looked_up(each, hits, ["kind", "text"])
    best = F.min(F.when(F.col("license").isNotNull(), F.struct((F.col("kind") != "whole").alias("rank"), (-F.col("cosine")).alias("c"), "license"))).alias("b")
    length = F.sum(F.when(F.col("license").isNotNull() & F.col("kind").isin("line", "spdx"), F.length("text")).otherwise(0)).alias("matched")
    own = of.groupBy("doc_id", "path", "size", "h").agg(best, length, F.count_if(F.col("pos") == 0).alias("copies"))
    share = F.when(~F.col("b.rank"), 1.0).when(F.col("b").isNotNull(), F.col("matched") / F.col("copies") / F.col("size"))
    own = own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), share.alias("share"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    own = own.union(silent).withColumn("dir", parent(F.col("path"))).checkpoint()
    files = own.where("license IS NOT NULL AND path IS NOT NULL").where(licence_file if licence_file is not None else F.col("share") >= FILE_SHARE)
    votes = files.groupBy("dir", "license").agg(F.count(F.lit(1)).alias("n"))
    of_dir = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("given")).checkpoint()
    dirs = own.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")).checkpoint()
    near = looked_up(up, of_dir, ["above"], "inner").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), F.col("b.given").alias("given")).checkpoint()
    j = looked_up(own, near, ["dir"])
    return j.select("doc_id", "path", F.coalesce("license", "given").alias("license"), F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"), "cosine", F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of every whole text of documents; see scan.

    Documents have no paths. The language and all digits of the id but the last stand for
    directories, so that 1234 lies in en/1/2/3, below the directory of 12; files are at any depth.
    They have no file names either: each document with a licence of its own speaks for its directory.
    """
    name = F.col("doc_id").cast("string")
    path = F.concat(F.coalesce("lang", F.lit("")), F.regexp_replace(F.regexp_replace(name, ".$", ""), "(.)", "/$1"), F.lit("/"), name)
    return scan(table(spark, sf_dir, "documents"), path, licence_file=F.col("license").isNotNull())


def oracle() -> str:
    """DuckDB SQL for op1_licenses: every unit against every template that shares a word."""
    rows = ", ".join(f"('{k}', {i}, '{name}', '{' '.join(words(text))}')" for k, ts in templates().items() for i, (name, text) in enumerate(ts))
    theta = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " END"
    spdx = SPDX.replace("'", "''")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') || regexp_replace(regexp_replace(CAST(doc_id AS VARCHAR), '.$', ''), '(.)', '/\\1', 'g') AS dir, coalesce(text, '') AS t FROM documents),
tpl AS (SELECT kind, t, license, unnest(string_split(text, ' ')) AS w FROM (VALUES {rows}) x(kind, t, license, text)),
tc AS (SELECT kind, t, license, w, count(*) AS tf FROM tpl GROUP BY ALL),
number AS (SELECT kind, count(DISTINCT t) AS n FROM tpl GROUP BY kind),
idf AS (SELECT kind, w, ln((1.0 + max(n)) / (1.0 + count(*))) + 1.0 AS idf FROM tc JOIN number USING (kind) GROUP BY kind, w),
tv AS (SELECT kind, t, license, w, sqrt(tf) * idf AS tw FROM tc JOIN idf USING (kind, w)),
tn AS (SELECT kind, t, sqrt(sum(tw * tw)) AS tnorm FROM tv GROUP BY ALL),
units AS (
  SELECT doc_id, CASE WHEN regexp_matches(text, '{spdx}') THEN 'spdx' ELSE 'line' END AS kind, text FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS text FROM docs)
  UNION ALL SELECT doc_id, 'block', text FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{GAP}')) AS text FROM docs) WHERE contains(trim(text, chr(10)), chr(10))
  UNION ALL SELECT doc_id, 'whole', t FROM docs),
each AS (SELECT row_number() OVER () AS u, kind, text FROM (SELECT DISTINCT kind, text FROM units)),
uc AS (SELECT u, kind, lower(w) AS w, count(*) AS tf FROM (SELECT u, kind, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM each) GROUP BY ALL),
uv AS (SELECT u, uc.kind, uc.w, sqrt(tf) * coalesce(idf, ln(1.0 + n) + 1.0) AS uw FROM uc JOIN number ON number.kind = uc.kind LEFT JOIN idf ON idf.kind = uc.kind AND idf.w = uc.w),
un AS (SELECT u, sqrt(sum(uw * uw)) AS unorm FROM uv GROUP BY u),
dots AS (SELECT u, kind, t, license, sum(uw * tw) AS dot FROM uv JOIN tv USING (kind, w) GROUP BY ALL HAVING count(*) >= {LEAST_SHARED}),
cosines AS (SELECT u, kind, license, round(dot / unorm / tnorm, 6) AS cosine FROM dots JOIN un USING (u) JOIN tn USING (kind, t)),
hits AS (SELECT kind, text, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY cosine DESC, license) AS rn FROM cosines WHERE cosine >= {theta}) JOIN each USING (u, kind) WHERE rn = 1
  UNION ALL SELECT kind, text, regexp_replace(regexp_extract(text, '{spdx}', 1), '(?i)-(only|or-later)$', ''), 1.0 FROM each WHERE kind = 'spdx'),
own AS (SELECT doc_id, license, cosine FROM (SELECT doc_id, license, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'whole', cosine DESC, license) AS rn FROM units JOIN hits USING (kind, text)) WHERE rn = 1),
given AS (SELECT above, license FROM (SELECT dir AS above, license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, license) AS rn FROM own JOIN docs USING (doc_id) GROUP BY dir, license) WHERE rn = 1),
up AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS above, k FROM docs, LATERAL (SELECT unnest(range(0, len(string_split(dir, '/')) + 1)) AS k)),
near AS (SELECT dir, above, license FROM (SELECT dir, above, license, row_number() OVER (PARTITION BY dir ORDER BY k DESC) AS rn FROM up JOIN given USING (above)) WHERE rn = 1)
SELECT docs.doc_id, docs.dir || '/' || docs.doc_id AS path, coalesce(own.license, near.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  own.cosine, CASE WHEN own.license IS NULL THEN near.above END AS from_dir
FROM docs LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = docs.dir
"""


ORACLE = oracle()
