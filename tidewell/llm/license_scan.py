r"""Licence scans, in DataFrame functions only.

Every line of a text is a possible header, and so is every run of 2 to ``LINES`` adjacent lines that are made of the notices' words,
as headers are wrapped (comment marks are no terms).  The whole text of a licence file (with LICENSE, LICENCE, UNLICENSE, COPYING, COPYRIGHT
or NOTICE in its name) is one unit more.  A unit is compared with the notices of known licences by the cosine of TF-IDF vectors (terms are
runs of ASCII letters and digits, case folded; inverse frequencies are counted over ``NOTICES``, and a term that none of them
has weighs as one found in none).  The whole of a licence file, and a line of over ``LONG`` characters, is compared with the full texts of licences too, with inverse
frequencies counted over these; their terms are kept in licence_texts.json.  Lines that hold none of a notice's essential terms cannot reach the threshold, so only
the others are scored: a notice's terms that are not essential have, together, less than the threshold of its length.

A file takes the licence of its best unit; a BSD licence with its second clause and without the third is BSD-2-Clause.  A file without one inherits: directories that hold a licence file with a known
licence are joined with the ancestors of all directories, and each directory takes the nearest, its own first; of several
licence files in one directory, that with the best score, then the first by path.

Defined results: null or empty text has no unit; a null path is in no directory and inherits nothing; a licence file at the top gives to all
directories; rows that share a path
are files of their own; ties between licences go to the first by name; an empty table gives an empty result; other columns
are left aside."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, sized, stored

THRESHOLD = 0.75

# Public licence names and their usual notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]

#: Further notices: they are weighed by the inverse frequencies of those above, whose scores so stay the same.
FURTHER = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]

#: A wrapped header has at most so many lines and, in all, characters: over three times the longest notice, which a run that long
#: can be near only by holding it more than once, and then a shorter run holds it.
LINES, CHARS = 12, 1000

#: A whole text without any of these is no licence's.
SPEAKS = "(?i)licen[sc]|permission|permitted|warrant"

#: Words that prose has everywhere: taken as essential last of all.
COMMON = frozenset("the a an and or of to in on is it that this these by for with not are be may only any as at under either without from you no use sa la le de un une et en el mit der die das und".split())

#: The word may stand anywhere in the name of a licence file, by itself: LICENSE, MIT-LICENSE.txt, COPYING.LESSER.
FILE_NAME = r"(?i)^(.*[._ -])?(un)?(licen[sc]es?|copying|copyright|notice)([._ -].*)?$"

#: Lines of more characters are compared with the full texts of licences too, of which none is shorter: minified sources hold them so.
LONG = 400

# The sentence of BSD licences above is that of both; what only the second clause has, and what only the third.
BSD_SECOND, BSD_THIRD = "redistributions in binary form must reproduce", "(endorse or promote products|neither the name)"


def _terms(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


def vectors() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse frequencies, that of an unknown term, and each notice's unit vector."""
    sets = [Counter(_terms(t)) for _, t in NOTICES]
    n = len(sets)
    df = Counter(t for s in sets for t in s)
    idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in sorted(df.items())}
    out = []
    for (name, _), s in zip(NOTICES, sets, strict=True):
        raw = {t: c * idf[t] for t, c in s.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out.append((name, {t: x / size for t, x in sorted(raw.items())}))
    return idf, math.log(n + 1) + 1, out


def headers() -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of all notices, the further ones too."""
    idf, unknown, notices = vectors()
    return notices + [(name, _unit(Counter(_terms(t)), idf, unknown)) for name, t in FURTHER]


def _unit(counts: dict[str, int], idf: dict[str, float], unknown: float) -> dict[str, float]:
    raw = {t: c * idf.get(t, unknown) for t, c in counts.items()}
    size = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / size for t, x in sorted(raw.items())}


@cache
def full_texts() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """The same as ``vectors`` for full texts of licences."""
    sets = json.loads(Path(__file__).with_name("licence_texts.json").read_text())
    df = Counter(t for s in sets.values() for t in s)
    idf = {t: math.log((len(sets) + 1) / (d + 1)) + 1 for t, d in sorted(df.items())}
    unknown = math.log(len(sets) + 1) + 1
    return idf, unknown, [(name, _unit(s, idf, unknown)) for name, s in sets.items()]


def essential(notices: list[tuple[str, dict[str, float]]], least: float = THRESHOLD) -> list[str]:
    """Terms of which a unit must hold one to reach ``least`` with any notice.

    A unit that shares only terms whose weights come, together, to less than ``least`` cannot reach it; any choice of the
    others does.  Terms that prose has least often are chosen first: long words, then numbers, then common words."""
    found = set()
    for _, v in notices:
        rest = 1.0
        for t in sorted(v, key=lambda t: (t in COMMON, t.isdigit(), -len(t), t)):
            if rest < (least - 1e-6) ** 2:
                break
            found.add(t)
            rest -= v[t] ** 2
    return sorted(found)


def _weights(idf: dict[str, float], unknown: float, notices: list[tuple[str, dict[str, float]]]) -> Column:
    """A fixed map: of each term its inverse frequency and its weight in each notice."""
    every = sorted(set(idf).union(*[v for _, v in notices]))
    table = {t: [idf.get(t, unknown), *[v.get(t, 0.0) for _, v in notices]] for t in every}
    return F.from_json(F.lit(json.dumps(table)), "map<string,array<double>>")


def _terms_of(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), "[^a-z0-9]+"), lambda t: t != "")


def nearest(unit: Column, idf: dict[str, float], unknown: float, notices: list[tuple[str, dict[str, float]]]) -> Column:
    """struct(score, licence) of the notice nearest to a text."""
    weights = _weights(idf, unknown, notices)
    names = F.array(*[F.lit(name) for name, _ in notices])
    zeros = F.array_repeat(F.lit(0.0), len(notices) + 1)

    def scored(counted):
        size = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda a, c: a + c["x"] * c["x"]))
        dots = F.aggregate(F.filter(counted, lambda c: c["w"].isNotNull()), zeros, lambda a, c: F.zip_with(a, c["w"], lambda y, w: y + c["x"] * w))
        one = lambda dot, name, size: F.struct((-F.when(size > 0, F.round(dot / size, 9)).otherwise(0.0)).alias("less"), name.alias("licence"))
        every = let(F.struct(size.alias("size"), dots.alias("dots")), lambda d: F.zip_with(F.slice(d["dots"], 2, len(notices)), names, lambda dot, name: one(dot, name, d["size"])))
        return let(F.array_min(every), lambda m: F.struct((-m["less"]).alias("score"), m["licence"].alias("licence")))

    def of(ts):
        at = F.filter(F.sequence(F.lit(0), F.size(ts)), lambda i: (i == F.size(ts)) | (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
        runs = lambda at: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.size(at) > 1),
            lambda k: let(
                F.struct((F.get(at, k + 1) - F.get(at, k)).alias("c"), F.try_element_at(weights, F.get(ts, F.get(at, k))).alias("w")),
                lambda p: F.struct((p["c"] * F.coalesce(F.get(p["w"], F.lit(0)), F.lit(unknown))).alias("x"), p["w"].alias("w")),
            ),
        )
        return let(let(at, runs), scored)

    return F.when(F.lit(True), let(F.array_sort(_terms_of(unit)), of))


def best(unit: Column) -> Column:
    """struct(score, licence) of the notice nearest to a text."""
    idf, unknown, _ = vectors()
    return nearest(unit, idf, unknown, headers())


def whole(text: Column) -> Column:
    """struct(score, licence) of the full licence text nearest to a text, null for a text that speaks of no licence."""
    return F.when(text.rlike(SPEAKS), nearest(text, *full_texts()))


def _hint() -> str:
    return "(?i)(^|[^a-z0-9])(" + "|".join(essential(headers())) + ")([^a-z0-9]|$)"


def wrapped(lines: Column) -> Column:
    """Runs of 2 to ``LINES`` adjacent lines that can be one header: a third of each line's terms at least are those of notices."""
    idf, unknown, _ = vectors()
    known = _weights(idf, unknown, headers())
    fits = lambda s: let(_terms_of(s), lambda ts: F.size(F.filter(ts, lambda t: F.try_element_at(known, t).isNotNull())) * 3 >= F.size(ts))

    def runs(d):
        ls, ok, n = d["lines"], d["ok"], F.size(d["lines"])
        ends = lambda s: F.filter(F.sequence(s + 2, F.greatest(F.least(s + LINES, n), s + 2)), lambda e: (e <= n) & F.forall(F.slice(ok, s + 1, e - s), lambda x: x))
        of = lambda s: F.transform(F.when(F.get(ok, s), ends(s)).otherwise(F.array().cast("array<int>")), lambda e: F.array_join(F.slice(ls, s + 1, e - s), " "))
        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of)), lambda u: (F.length(u) <= CHARS) & u.rlike(_hint()))

    lined = F.struct(lines.alias("lines"), F.transform(lines, lambda s: F.when(F.length(s) <= CHARS, fits(s)).otherwise(F.lit(False))).alias("ok"))
    return F.when(F.exists(lines, lambda s: s.rlike(_hint())), let(lined, runs)).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame) -> DataFrame:
    """``files``: path, text.  Adds own_licence, own_score: of its best line or header, or of the whole of a licence file."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    named = F.substring_index("path", "/", -1).rlike(FILE_NAME)
    order = lambda b: F.struct((-b["score"]).alias("less"), b["licence"].alias("licence"))
    near = lambda units: F.transform(F.filter(F.transform(units, best), lambda b: b["score"] >= THRESHOLD), order)

    def tops(d):
        # the wrapped headers inside a full licence text are its own
        units = F.concat(F.filter(d["lines"], lambda s: s.rlike(_hint())), F.when(d["full"]["score"] >= THRESHOLD, none).otherwise(wrapped(d["lines"])), F.when(d["named"], F.array(d["text"])).otherwise(none))
        long = F.transform(F.filter(d["lines"], lambda s: (F.length(s) > LONG) & s.rlike(SPEAKS)), lambda s: nearest(s, *full_texts()))
        full_lines = F.transform(F.filter(long, lambda b: b["score"] >= THRESHOLD), order)
        return F.concat(near(units), full_lines, F.when(d["full"]["score"] >= THRESHOLD, F.array(order(d["full"]))).otherwise(F.array().cast("array<struct<less:double,licence:string>>")))

    parts = F.struct(text.alias("text"), F.split(text, "\n", -1).alias("lines"), F.coalesce(named, F.lit(False)).alias("named"), F.when(named, whole(text)).alias("full"))
    out = files.withColumn("_top", F.array_min(let(parts, tops)))
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    two = (F.col("_top.licence") == "BSD-3-Clause") & words.rlike(BSD_SECOND) & ~words.rlike(BSD_THIRD)
    return out.withColumn("own_licence", F.when(two, "BSD-2-Clause").otherwise(F.col("_top.licence"))).withColumn("own_score", -F.col("_top.less")).drop("_top")


def parent(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds licence and inherited_from (the directory whose licence file gave it, empty for the top; null for its own)."""
    at = scanned.withColumn("_dir", parent(F.col("path"))).withColumn("_file", F.substring_index("path", "/", -1).rlike(FILE_NAME))
    giving = at.where("_file and own_licence is not null and _dir is not null").groupBy(F.col("_dir").alias("_holder")).agg(
        F.min(F.struct((-F.col("own_score")).alias("less"), "path", "own_licence")).alias("_g")
    )
    giving = stored(giving.select("_holder", F.col("_g.own_licence").alias("_given")))
    dirs = at.where("_dir is not null").select("_dir").distinct()
    depth = F.size(F.split("_dir", "/"))
    steps = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.call_function("substring_index", F.col("_dir"), F.lit("/"), k).alias("up")))
    ups = dirs.select("_dir", F.explode(steps).alias("s")).select("_dir", "s.depth", F.col("s.up").alias("_holder"))
    nearest = ups.join(sized(giving), "_holder").groupBy("_dir").agg(F.max(F.struct("depth", "_holder", "_given")).alias("_n"))
    nearest = stored(nearest.select(F.col("_dir").alias("_of"), F.col("_n._holder").alias("_holder"), F.col("_n._given").alias("_given")))
    out = at.join(sized(nearest), F.col("_dir") == F.col("_of"), "left")
    return out.withColumn("licence", F.coalesce("own_licence", "_given")).withColumn("inherited_from", F.when(F.col("own_licence").isNull(), F.col("_holder"))).drop("_dir", "_file", "_of", "_holder", "_given")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents carry no path: each is placed at source/lang/(id by 4096)/(id by 64)/id.txt.

    A document of fewer than 60 words that names a licence in a line of its own, or whose whole text, of any length, is near a
    notice or a full licence text, is the licence file LICENSE.id of the directory one level up."""
    text = F.coalesce("text", F.lit(""))
    match = F.coalesce(F.when(text.rlike(SPEAKS), F.greatest(best(text)["score"], whole(text)["score"]) >= THRESHOLD), F.lit(False))
    short = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")) < 60
    notice = F.exists(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda s: s.rlike(r"(?i)^(licensed|released|this work is licensed) under "))
    base = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.expr("string(doc_id div 4096)"))
    inner = F.concat(base, F.lit("/"), F.expr("string(doc_id div 64)"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", "text", F.when((short & notice) | match, F.concat(base, F.lit("/LICENSE."), F.col("doc_id").cast("string"))).otherwise(inner).alias("path"))


def op6(docs: DataFrame) -> DataFrame:
    found = stored(scan(document_paths(docs)).drop("text"))
    return inherit(found).select("doc_id", "path", "own_licence", F.round("own_score", 6).alias("own_score"), "licence", "inherited_from")


def _sql() -> str:
    idf, unknown, notices = vectors()
    rows = ", ".join(f"({k}, '{name}', '{t}', {v!r}::DOUBLE)" for k, (name, vec) in enumerate(notices) for t, v in vec.items())
    known = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items())
    return rf"""
WITH f AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, len(regexp_split_to_array(trim(coalesce(text, ''), ' '), '[\x20\x09-\x0D]+')) < 60 AS short,
         len([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '(?i)^(licensed|released|this work is licensed) under ')]) > 0 AS noted,
         coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 4096) AS base FROM documents),
p AS (SELECT *, short AND noted AS is_file, CASE WHEN short AND noted THEN base || '/LICENSE.' || doc_id ELSE base || '/' || (doc_id // 64) || '/' || doc_id || '.txt' END AS path,
             CASE WHEN short AND noted THEN base ELSE base || '/' || (doc_id // 64) END AS dir FROM f),
u AS (SELECT rid, unnest(string_split(t, chr(10)) || CASE WHEN is_file THEN [t] ELSE []::VARCHAR[] END) AS unit FROM p),
l AS (SELECT DISTINCT unit, [x FOR x IN regexp_split_to_array(lower(unit), '[^a-z0-9]+') IF x <> ''] AS ts FROM u),
idf(term, v) AS (VALUES {known}), vec(k, name, term, v) AS (VALUES {rows}),
tf AS (SELECT unit, term, count(*) AS c FROM (SELECT unit, unnest(ts) AS term FROM l) GROUP BY ALL),
x AS (SELECT unit, tf.term, c * coalesce(idf.v, {unknown!r}::DOUBLE) AS x FROM tf LEFT JOIN idf USING (term)),
z AS (SELECT unit, sqrt(sum(x * x)) AS size FROM x GROUP BY unit),
c AS (SELECT x.unit, vec.k, vec.name, round(sum(x.x * vec.v) / any_value(z.size), 9) AS score FROM x JOIN vec USING (term) JOIN z ON z.unit = x.unit GROUP BY ALL),
b AS (SELECT u.rid, min(struct_pack(less := -score, licence := name)) AS m FROM u JOIN c USING (unit) WHERE score >= {THRESHOLD} GROUP BY u.rid),
o AS (SELECT p.*, b.m.licence AS own_licence, -b.m.less AS own_score FROM p LEFT JOIN b USING (rid)),
g AS (SELECT dir, min(struct_pack(less := -own_score, path := path, lic := own_licence)).lic AS lic FROM o WHERE is_file AND own_licence IS NOT NULL GROUP BY dir),
i AS (SELECT o.*, g1.lic AS l1, g2.lic AS l2 FROM o LEFT JOIN g g1 ON g1.dir = o.dir LEFT JOIN g g2 ON g2.dir = o.base)
SELECT doc_id, path, own_licence, round(own_score, 6) AS own_score, coalesce(own_licence, l1, l2) AS licence,
       CASE WHEN own_licence IS NULL THEN CASE WHEN l1 IS NOT NULL THEN dir WHEN l2 IS NOT NULL THEN base END END AS inherited_from FROM i
"""


#: What the query gives where notices stand in one line each, are those of ``NOTICES``, and no full licence text is among the documents.
SQL = _sql()
