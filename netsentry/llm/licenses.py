"""Licence scan: every line of a text against licence templates by the Dice
coefficient over word bigrams. DataFrame functions only.

A line is lower-cased (A-Z) and cut into words (runs of a-z, 0-9 and
characters above ASCII); its bigrams are the distinct pairs of neighbouring
words. Dice = 2 * common / (line's + template's). A template of ``t`` bigrams
can reach the threshold only with lines of ``t*d/(2-d)`` to ``t*(2-d)/d``
bigrams: most lines are dropped by their size alone, from the number of spaces
in them, before a word is cut out, and each line that is left meets only the
templates of fitting size.

A document's rows never leave their partition: lines are an array of the row,
templates are literals of the plan (a fixed list), and the answer is one
projection without a shuffle.

Defined results: null, empty and one-word texts match nothing; of equal Dice
values the template first in text order wins; repeated rows each get their
row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import ascii_lower

#: Notices as they stand in files, by licence id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MIN_DICE = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(NOT_WORD, " ", text.translate({c: c + 32 for c in range(65, 91)})).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, least: float) -> tuple[float, float]:
    """Numbers of bigrams with which a Dice value of ``least`` is possible."""
    return n * least / (2 - least), n * (2 - least) / least


def words_of(line: Column) -> Column:
    return F.filter(F.split(ascii_lower(line), NOT_WORD), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_DICE,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_lines`` (lines that match), ``license`` and ``dice`` of the
    best match, and ``licenses`` (all matched ids, sorted, comma-joined)."""
    sized = {name: g for name, t in templates.items() if (g := template_bigrams(t))}
    bounds = [size_bounds(len(g), least) for g in sized.values()] or [(1.0, 0.0)]
    low = min(b[0] for b in bounds)
    match = "struct<dice:double,license:string>"

    def against(grams: Column) -> Column:
        n = F.size(grams)
        options = []
        for name, g in sized.items():
            lo, hi = size_bounds(len(g), least)
            dice = 2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, g)))) / (n + F.lit(len(g)))
            options.append(F.when(n.between(lo, hi), F.struct((-dice).alias("dice"), F.lit(name).alias("license"))))
        return F.array_min(F.filter(F.array(*options).cast(f"array<{match}>"), lambda x: x["dice"] <= -least))

    # A line of b distinct bigrams has at least b separators; a long line may still have few distinct ones.
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                     lambda x: F.regexp_like(x, F.lit(r"[a-zA-Z0-9\x{80}-\x{10FFFF}]" + NOT_WORD + r"[a-zA-Z0-9\x{80}-\x{10FFFF}]")))
    grams = F.filter(F.transform(lines, lambda x: bigrams_of(words_of(x))), lambda g: F.size(g) >= low)
    found = F.filter(F.transform(grams, against), lambda x: x.isNotNull())
    best = F.array_min("found")
    return (docs.select(F.col(key).alias("doc_id"), found.alias("found"))
            .select(F.col("doc_id").alias(key), F.size("found").cast("long").alias("n_lines"), best["license"].alias("license"),
                    (-best["dice"]).alias("dice"),
                    F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses")))
