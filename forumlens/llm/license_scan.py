"""License scans: MinHash bands over overlapping text windows (DataFrame operations only).

Texts and templates become lower-case words (letters and digits). Templates are put
in length classes; a class of at most L words scans windows of 2L words every L words,
so every run of L words lies whole in a window. A window that holds a copy with
containment ``min_containment`` has a Jaccard similarity of at least ``least_jaccard``
with the template, and the number of one-row bands is chosen so that it shares a band
with probability ``recall`` or more. Windows found that way are verified by exact
shingle containment.

Texts are first tested for *required words*: as at most ``(1 - min_containment)`` of a
template's shingles may be missing, a set of words that touches more shingles than
that must occur in part, so a text with none of them cannot match (nothing is lost).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference lines, notices and grants of public licenses, and their SPDX identifiers.
#: The notices of the GNU licenses differ by a word or two among versions, so they name the family.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
                   "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
                   "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
                   "distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL", "under the terms of the GNU General Public License as published"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published"),
    ("CC0-1.0", "have dedicated all copyright and related and neighboring rights to this software to the public domain "
                "worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SHINGLE = 3


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(ws: Sequence[str]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(ws[i:i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)))


def required_words(text: str, min_containment: float) -> list[str]:
    """Words of which at least one occurs in every text that contains enough of the template."""
    sh = _shingles(_words(text))
    spare = math.floor((1 - min_containment) * len(sh) + 1e-9)
    chosen, touched = [], set()
    # Long words are the rare ones as a rule.
    for w in sorted(dict.fromkeys(_words(text)), key=lambda x: (-len(x), x)):
        if len(touched) > spare:
            break
        new = {s for s in sh if w in s} - touched
        if new:
            chosen.append(w)
            touched |= new
    # Drop words that the others make needless.
    for w in list(chosen):
        rest = [x for x in chosen if x != w]
        if len({s for s in sh if any(x in s for x in rest)}) > spare:
            chosen = rest
    return chosen


def bands_needed(jaccard: float, recall: float) -> int:
    """Bands of one row so that sets of this similarity share one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard))


def _hashes(ws: Column) -> Column:
    n = F.size(ws) - (SHINGLE - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(
        *[F.get(ws, i + (k - 1)) for k in range(SHINGLE)])))


def _minhashes(sh: Column, bands: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(
        b, F.array_min(F.transform(sh, lambda h: F.xxhash64(h, b)))))


def _holds(text: Column, need: Sequence[str]) -> Column:
    return text.rlike(r"(?<![\p{L}\p{N}])(" + "|".join(sorted(need)) + r")(?![\p{L}\p{N}])")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, min_containment: float = 0.8,
         recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, license, containment, word_at, windows), one for each document and
    license of which a window has at least ``min_containment`` of a template's shingles.

    ``word_at``: first word (from 0) of the first such window; ``windows``: how many hold it.
    Null and empty texts match nothing; rows with the same id are one document; a null id
    is an id like others; templates of under 3 words are refused; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if any(len(_words(t)) < SHINGLE for _, t in templates):
        raise ValueError(f"templates need {SHINGLE} words")
    classes: dict[int, list[tuple[str, str]]] = {}
    for name, text in templates:
        classes.setdefault(1 << (len(_words(text)) - 1).bit_length(), []).append((name, text))
    if not classes:
        return spark.createDataFrame([], "doc_id long, license string, containment double, word_at int, windows long")
    kinds, listed, every = [], [], set()
    for length, members in sorted(classes.items()):
        need = {w for _, t in members for w in required_words(t, min_containment)}
        # At worst a template of length/2 + 1 words in a window of 2 * length words.
        t = max(SHINGLE, length // 2 + 1) - SHINGLE + 1
        least = min_containment * t / (2 * length - SHINGLE + 1 + (1 - min_containment) * t)
        bands = bands_needed(least, recall)
        kinds.append(F.when(_holds(F.col("low"), need), F.struct(F.lit(length).alias("length"), F.lit(bands).alias("bands"))))
        listed += [(n, _words(t), length, bands) for n, t in members]
        every |= need
    # one pass over the texts: the classes of which a text holds a required word
    texts = (docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("low")).where(_holds(F.col("low"), every))
             .select("doc_id", F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("ws"),
                     F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("ws") >= SHINGLE))
    windows = (texts.select("doc_id", "ws", F.explode("kinds").alias("k"))
               .select("doc_id", "k", F.posexplode(F.transform(
                   F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - SHINGLE), F.col("k.length")),
                   lambda i: F.slice("ws", i + 1, 2 * F.col("k.length")))).alias("nr", "part"))
               .where(F.size("part") >= SHINGLE)
               .select("doc_id", "k", (F.col("nr") * F.col("k.length")).alias("word_at"), _hashes(F.col("part")).alias("sh"))
               .select("*", _minhashes(F.col("sh"), F.col("k.bands")).alias("mh")))
    # The templates are a fixed list of the program, so its band table is small.
    table = spark.createDataFrame(listed, "license string, ws array<string>, length int, bands int")
    keys = table.select("license", "length", "bands", _hashes(F.col("ws")).alias("t_sh")).select(
        "license", "length", "t_sh", F.explode(_minhashes(F.col("t_sh"), F.col("bands"))).alias("band"))
    bound = F.array(*[F.lit(b) for b in sorted({r.band for r in keys.select("band").collect()})])
    found = (windows.select("doc_id", "word_at", F.col("k.length").alias("length"), "sh",
                            F.explode(F.array_intersect("mh", bound)).alias("band"))
             .join(F.broadcast(keys), ["length", "band"])
             .select("doc_id", "word_at", "license",
                     (F.size(F.array_intersect("sh", "t_sh")) / F.size("t_sh")).alias("containment"))
             .where(F.col("containment") >= min_containment))
    best = found.groupBy("doc_id", "license", "word_at").agg(F.max("containment").alias("containment"))
    return best.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("word_at").alias("word_at"), F.count(F.lit(1)).alias("windows"))
