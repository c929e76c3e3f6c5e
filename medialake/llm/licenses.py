"""Licence scan (DataFrame functions only).

Templates and texts are sparse TF-IDF vectors, with document frequencies of the
templates' words counted over the whole corpus.  Every other word of a text weighs as one
that a single document holds, so prose that happens to hold the words of a statement among
its own is no statement.  Comment marks and signs are no words, and a copyright
notice of up to 200 characters before "all rights reserved" on its line is passed
over.  The units compared are every line of a text, every run of consecutive lines of
at most ``ROOM`` times the words of a template it may match (headers wrapped over
lines, wherever they stand; lines without a word are passed over) and, for licence
files, the whole text.

A unit may take a template if their cosine is at least ``min_cosine``, if it
holds the template's words that tell it from its relatives (versions, variants,
names: ``needs``) and none that tells a relative from it (``bars``); it carries
the licence of the one with the greatest cosine.  A text carries that of its
unit with the longest template among those of ``SURE`` or more (licences share
paragraphs), else with the greatest cosine.

Exact pruning: from each template the heaviest words are taken as anchors
until the rest of its vector is shorter than ``min_cosine``; a unit without
any anchor cannot reach that cosine, so only lines with an anchor are expanded.
Runs are made around their first line with an anchor, and only where the words
of all lines in reach could make up that cosine with one template: a cosine is
at most the length of the part of a template whose words the unit holds.

A file without a licence of its own inherits that of the licence file in the
nearest directory above it: directories are expanded to their ancestors and
joined by path with the directories that hold a licence file; a directory with
a hundred thousand files is looked up once, and one that holds a great part of
all files is not joined in one task.

What travels to all tasks (word weights and templates) is bounded by the fixed
template list.

Defined cases: a null or empty text has no licence of its own and may inherit;
a null path inherits nothing, but keeps a licence of its own; of equal cosines the licence that sorts first
wins; an SPDX tag that names several licences carries one of them; of several licence files in a directory that with the greatest cosine,
then the licence that sorts first; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import join_spread, materialise

# Usual statements, standard headers, and the paragraphs by which the full texts of public licences are known.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Artistic-1.0", "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
for _name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    _short, _version = _name.split("-")
    _version = _version.removesuffix(".0")
    TEMPLATES += [(_name, f"This work is licensed under the {_GNU[_short]}, version {_version}."), (_name, f"Licensed under the {_short}v{_version}.")]
_CC = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version, _scope in (("3.0", "Unported"), ("4.0", "International")):
        _name, _long = f"CC-{_kind}-{_version}", "-".join(_CC[k] for k in _kind.split("-"))
        TEMPLATES += [(_name, f"Licensed under CC {_kind} {_version}."), (_name, f"This work is licensed under a Creative Commons {_long} {_version} {_scope} License.")]
TEMPLATES = sorted(set(TEMPLATES))
_TAG = "SPDX-License-Identifier: "
TEMPLATES += [(_name, _TAG + _name) for _name in sorted({n for n, _ in TEMPLATES} - {"Proprietary"})]
#: Words that tell a licence or a variant of it from its relatives.
TELLING = {"affero", "apache", "artistic", "boost", "eclipse", "lesser", "mozilla", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike"}
#: A copyright notice before the words that count.
NOTICE = r"(?i)(?:copyright|\(c\)|©)[^\n]{0,200}?(all rights reserved)"
_SPLIT = "[^a-z0-9]+"
_NOWHERE = "\x00"  # directory of a file without a path
#: Cosine from which a unit is sure enough for its length to count.
SURE = 0.9
#: Words of a run, in lengths of the longest template: its first and last line hold other words too.
ROOM = 1.5


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def needs(name: str, text: str) -> list[str]:
    """Words of a template that a unit must hold: version and variant, the names in ``TELLING``, and all of the id in an SPDX tag."""
    own = words_of(name)
    own += ["v".join(own[:2])]
    if "." not in name and not text.startswith(_TAG):  # numbers of clauses
        own = [w for w in own if not w.isdigit()]
    return sorted(set(words_of(text)) & (set(own) - {"0"} | TELLING))


def bars(text: str) -> list[str]:
    """Words that a unit must not hold to take a template."""
    return sorted(TELLING - set(words_of(text)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _word_list(found: list[str]) -> Column:
    return F.split(F.lit(" ".join(found)), " ")


def word_weights(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """idf of each word: ln((1 + documents) / (1 + documents with it)) + 1, over all documents; under "" that of a word in one document."""
    held = F.array_intersect(F.split(F.lower(F.coalesce(text_col, F.lit(""))), _SPLIT), _word_list(vocabulary))
    rows = docs.select(F.explode(F.array_append(held, F.lit("\t"))).alias("w")).groupBy("w").count().collect()
    found = {r[0]: r[1] for r in rows}
    n = found.pop("\t", 0)
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) + 1 for w in vocabulary} | {"": math.log((1 + n) / 2) + 1}


def template_vectors(templates, idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    out = []
    for name, text in templates:
        v = {w: n * idf[w] for w, n in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {w: x / norm for w, x in v.items()}))
    return out


def anchors(vectors, min_cosine: float) -> list[str]:
    """Words such that a unit without all of them is below ``min_cosine`` to every template."""
    out = set()
    for _, v in vectors:
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
            if rest < min_cosine * min_cosine * (1 - 1e-9):
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def any_of(found: list[str]) -> str:
    """Pattern of the given words (letters and digits) in which those with a common beginning share it."""
    if not found:
        return "[^\\s\\S]"
    heads: dict[str, list[str]] = {}
    for w in found:
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [c + any_of(rest) if rest != [""] else c for c, rest in sorted(heads.items()) if c]
    body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
    return body if "" not in heads else f"(?:{body})?"


def units(docs: DataFrame, text_col: str, whole: Column, mark: Column, vectors, lengths: list[int], min_cosine: float, needed: list[list[str]] | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with one row for each unit (``_line``): lines with an anchor, runs, and the array ``whole``.

    Runs are those of two lines or more that may reach ``min_cosine`` with a
    template, whose words (``lengths``) theirs are at most ``ROOM`` to one and
    whose ``needed`` words they hold.  Each run is made once, from the first of
    its lines with an anchor.  Each step explodes rows, so that the next one
    reads a column instead of nesting in it.
    """
    keep = [c for c in docs.columns if c != text_col]
    most = int(ROOM * max(lengths, default=0))
    # one literal each: folded from text, instead of thousands of expressions
    needed = needed or [[] for _ in vectors]
    weights = json.dumps([{"most": int(ROOM * n), "need": need, "v": [{"w": w, "xx": x * x} for w, x in v.items()]} for n, need, (_, v) in zip(lengths, needed, vectors)])
    terms = F.from_json(F.lit(weights), "array<struct<most:int,need:array<string>,v:array<struct<w:string,xx:double>>>>")
    vocabulary = _word_list(sorted({w for _, v in vectors for w in v}))
    no_lines = F.array().cast("array<struct<s:string,n:int,anchor:boolean>>")

    def near(lines: Column, among: Column) -> Column:
        """Of the templates ``among``, those whose needed words ``lines`` hold, and of all words a great enough part."""
        held = F.array_intersect(words(F.array_join(lines.s, " ")), vocabulary)
        share = lambda t, h: F.aggregate(t.v, F.lit(0.0), lambda a, e: a + F.when(F.array_contains(h, e.w), e.xx).otherwise(0.0))
        able = lambda h: F.filter(among, lambda t: F.forall(t.need, lambda w: F.array_contains(h, w)) & (share(t, h) >= min_cosine * min_cosine * (1 - 1e-9)))
        return F.element_at(F.transform(F.array(held), able), 1)  # array(held): made once

    def n_words(lines: Column) -> Column:
        return F.aggregate(lines.n, F.lit(0), lambda a, n: a + n)

    def fitting(lines: Column, ends: bool, limit) -> Column:
        """The first of ``lines`` up to ``limit`` words, and before one with an anchor if ``ends``."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("go"))

        def step(a, x):
            go = a.go & (a.n + x.n <= limit) & (~x.anchor if ends else F.lit(True))
            return F.struct((a.n + F.when(go, x.n).otherwise(0)).alias("n"), (a.k + go.cast("int")).alias("k"), go.alias("go"))

        return F.slice(lines, 1, F.aggregate(lines, start, step, lambda a: a.k))

    def window(lines: Column, i: Column) -> Column:
        """Around line ``i``, which has an anchor: (itself; lines before it, nearest first; itself and those after)."""
        first = F.greatest(i - most, F.lit(1))
        before = fitting(F.reverse(F.slice(lines, first, i - first)), True, most)
        return F.struct(F.get(lines, i - 1).s.alias("line"), before.alias("before"), fitting(F.slice(lines, i, most), False, most).alias("after"))

    line = lambda x: F.struct(x.alias("s"), F.size(words(x)).alias("n"), F.regexp_like(F.lower(x), mark).alias("anchor"))
    lines = F.filter(F.transform(F.split(text_col, "\n"), line), lambda x: x.n > 0)
    rows = docs.select(*keep, whole.alias("_whole"), F.explode(F.array(lines)).alias("_lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_lines", i - 1).anchor)
    around = F.transform(F.when(F.size("_lines") > 0, at).otherwise(F.array().cast("array<int>")), lambda i: window(F.col("_lines"), i))
    files = F.transform("_whole", lambda x: F.struct(x.alias("line"), no_lines.alias("before"), no_lines.alias("after")))
    rows = rows.select(*keep, F.explode(F.concat(around, files)).alias("_w"))
    whole_window = F.concat("_w.before", "_w.after")
    rows = rows.select(*keep, "_w", F.explode(F.array(F.when(F.size(whole_window) > 1, near(whole_window, terms)))).alias("_near"))
    longest = F.array_max("_near.most")
    cut = F.struct(fitting(F.col("_w.before"), False, longest).alias("before"), fitting(F.col("_w.after"), False, longest).alias("after"))
    rows = rows.select(*keep, F.col("_w.line").alias("_own"), "_near", F.explode(F.array(F.when(F.size("_near") > 0, cut))).alias("_w"))
    made = F.transform(F.sequence(F.lit(0), F.size("_w.before")), lambda b: F.transform(F.sequence(F.lit(1), F.size("_w.after")), lambda a: F.concat(F.reverse(F.slice("_w.before", 1, b)), F.slice("_w.after", 1, a))))
    short = F.filter(F.flatten(made), lambda x: (F.size(x) > 1) & (n_words(x) <= longest))
    found = F.filter(short, lambda x: F.size(near(x, F.filter("_near", lambda t: t.most >= n_words(x)))) > 0)
    joined = F.when(F.size("_w.after") > 0, F.transform(found, lambda x: F.array_join(x.s, " "))).otherwise(F.array().cast("array<string>"))
    return rows.select(*keep, F.explode(F.concat(F.array("_own"), F.coalesce(joined, F.array().cast("array<string>")))).alias("_line"))


def is_license_file(path: Column) -> Column:
    return F.coalesce(F.regexp_like(F.element_at(F.split(path, "/"), -1), F.lit(r"(?i)^(licen[sc]e|copying|unlicense)(\..*)?$")), F.lit(False))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def own_licenses(docs: DataFrame, path_col: str, text_col: str, templates=TEMPLATES, min_cosine: float = 0.75) -> DataFrame:
    """(path, _hash, license, cosine) of the texts with a licence of their own; ``_hash`` is that of the text."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    idf = word_weights(docs, text_col, vocabulary)
    other = idf.pop("")
    vectors = template_vectors(templates, idf)
    needed, lengths = [needs(*t) for t in templates], [len(words_of(t)) for _, t in templates]
    rows = [(i, name, len(needed[i]), lengths[i], w, x, w in needed[i], False) for i, (name, v) in enumerate(vectors) for w, x in v.items()]
    rows += [(i, name, len(needed[i]), lengths[i], w, 0.0, False, True) for i, (name, t) in enumerate(templates) for w in bars(t)]
    terms = F.broadcast(spark.createDataFrame(rows, "template int, license string, needs int, words int, w string, x double, need boolean, bar boolean"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "w string, idf double"))
    marks = anchors(vectors, min_cosine)
    mark = F.lit(r"(^|[^a-z0-9])(" + any_of(marks) + r")($|[^a-z0-9])")
    whole = F.when(is_license_file(F.col(path_col)), F.array("_text")).otherwise(F.array().cast("array<string>"))
    held = docs.select(path_col, F.coalesce(text_col, F.lit("")).alias("_text")).where(F.arrays_overlap(F.split(F.lower("_text"), _SPLIT), _word_list(marks)))
    held = held.select(path_col, F.xxhash64("_text").alias("_hash"), F.regexp_replace("_text", NOTICE, "$1").alias("_text"))
    found = units(held, "_text", whole, mark, vectors, lengths, min_cosine, needed)
    # equal units of a text are one, as a cosine does not change with the times its words are counted
    tf = found.select(path_col, "_hash", F.xxhash64("_line").alias("_unit"), F.explode(words(F.col("_line"))).alias("w")).join(weights, "w", "left").groupBy(path_col, "_hash", "_unit", "w").agg((F.count("*") * F.coalesce(F.first("idf"), F.lit(other))).alias("y"))
    norms = tf.groupBy(path_col, "_hash", "_unit").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.collect_list(F.struct("w", "y")).alias("v"))
    dots = norms.select(path_col, "_hash", "_unit", "norm", F.explode("v").alias("v")).select(path_col, "_hash", "_unit", "norm", "v.w", "v.y").join(terms, "w")
    cosines = dots.groupBy(path_col, "_hash", "_unit", "template", "license", "needs", "words").agg((F.sum(F.col("x") * F.col("y")) / F.first("norm")).alias("c"), F.count_if("need").alias("held"), F.count_if("bar").alias("barred"))
    able = cosines.where((F.col("c") >= min_cosine) & (F.col("held") == F.col("needs")) & (F.col("barred") == 0))
    units_of = able.groupBy(path_col, "_hash", "_unit").agg(F.min(F.struct((-F.round("c", 9)).alias("c"), "license", (-F.col("words")).alias("n"))).alias("u"))
    best = units_of.groupBy(path_col, "_hash").agg(F.min(F.struct(F.when(F.col("u.c") <= -SURE, F.col("u.n")).otherwise(0).alias("n"), F.col("u.c").alias("c"), F.col("u.license").alias("license"))).alias("b"))
    return best.select(path_col, "_hash", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, min_cosine: float = 0.75) -> DataFrame:
    """One row per document: id, path, license, cosine, origin (``own``, ``inherited`` or null), license_dir."""
    own = materialise(own_licenses(docs, path_col, text_col, templates, min_cosine))
    slim = materialise(docs.select(id_col, path_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"), F.coalesce(directory(F.col(path_col)), F.lit(_NOWHERE)).alias("_dir")))
    files = own.where(is_license_file(F.col(path_col))).select(directory(F.col(path_col)).alias("license_dir"), F.struct((-F.col("cosine")).alias("c"), "license").alias("b"))
    holders = files.groupBy("license_dir").agg(F.min("b").alias("b")).select("license_dir", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    dirs = materialise(slim.groupBy("_dir").agg(F.count("*").alias("_files")))
    parts = F.split("_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = dirs.where(F.col("_dir") != _NOWHERE).select("_dir", F.explode(ancestors).alias("license_dir")).distinct()
    nearest = above.join(holders, "license_dir").groupBy("_dir").agg(F.max_by(F.struct("license_dir", "license", "cosine"), F.length("license_dir")).alias("up"))
    keyed = own.withColumnsRenamed({path_col: "_own_path", "_hash": "_own_hash"})
    joined = slim.join(keyed, slim[path_col].eqNullSafe(keyed["_own_path"]) & (slim["_hash"] == keyed["_own_hash"]), "left")
    placed = join_spread(joined, dirs.join(nearest, "_dir", "left"), "_dir", "_files", dirs.agg(F.sum("_files")).first()[0] or 0)
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited")
    return placed.select(id_col, path_col, F.coalesce("license", "up.license").alias("license"), F.coalesce("cosine", "up.cosine").alias("cosine"), origin.alias("origin"), F.when(origin == "inherited", F.col("up.license_dir")).alias("license_dir"))
