"""Licence scans: lines and paragraphs compared to licence templates, with DataFrame functions only.

A text is cut into its lines, and into paragraphs (parted by blank lines) of more than one line. A
unit is normalised: lower case, everything but letters and digits to single spaces. Its set of word
bigrams is compared to a template's by the Dice coefficient, 2 * common / (size + size). A
coefficient of t is only possible for sizes from n * t / (2 - t) to n * (2 - t) / t, where n is the
template's size; templates out of these bounds are not compared. Such a unit also has so many of the
template's bigrams that some of a few anchor words, chosen to be in enough of them, must stand in it:
texts and units without any anchor are passed over before they are normalised. The templates are few, fixed texts
and go into the plan as literals, so that a scan is one pass without any shuffle of texts.

``notices`` also takes the whole text and each window of it that has as many words as a template, so
that a notice is met across blank lines, in comments and inside longer lines. A text has a window that
can match only if it has ``needed`` of the template's bigrams, and a window is only compared if so many
of its places have one; both are exact.

Null and empty texts, and units of fewer than two words, match nothing. A row with a null id is
reported under the null id. Rows that share an id are reported together. A unit that matches several
templates, equally well or not, gives a row for each. Texts of any length are scanned whole; an empty
table gives no rows. Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices as they are commonly written.
TEMPLATES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


#: Words that stand in too many texts to be anchors.
COMMON = set("a an and any are as at be by for from in is it may not of on or out that the this to under use with you".split())


def _template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(grams: dict[str, list[str]], threshold: float) -> list[str]:
    """Words such that every unit that can match a template has one of them in it.

    A match has ``needed`` of the template's bigrams or more; words are taken, those in the most
    bigrams first among the less common ones, until fewer than ``needed`` bigrams are left without one."""
    needed = {name: _needed(len(g), threshold) for name, g in grams.items()}
    left = {name: [x.split() for x in g] for name, g in grams.items()}
    out: list[str] = []
    while open_ := [name for name in left if len(left[name]) >= needed[name]]:
        used = Counter(w for name in open_ for x in left[name] for w in set(x))
        best = max(used, key=lambda w: (w not in COMMON, len(w) > 4, used[w], len(w), w))
        out.append(best)
        left = {name: [x for x in g if not any(_in(best, w) for w in x)] for name, g in left.items()}
    return out


def _in(anchor: str, word: str) -> bool:
    """Short anchors are whole words, longer ones any part of a word."""
    return anchor in word if len(anchor) > 4 else anchor == word


def _anchored(text: Column, words: list[str]) -> Column:
    """Whether a text has an anchor: plain searches for the longer ones, each by itself, which takes a
    fraction of one regular expression for all."""
    low, out = F.lower(text), F.lit(False)
    for w in sorted(words, key=len, reverse=True):
        whole = rf"{w}(?<![\p{{L}}\p{{N}}]{w})(?![\p{{L}}\p{{N}}])"
        out = out | (F.contains(low, F.lit(w)) if len(w) > 4 else low.rlike(whole))
    return out


def normalised_words(unit: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))
    return F.when(text != "", F.split(text, " "))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words; null below two words."""
    return F.when(F.size(words) > 1, F.array_distinct(_pairs(words)))


def _needed(size: int, threshold: float) -> int:
    """How many of a template's bigrams every match has."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _unit_tests(grams: dict[str, list[str]], threshold: float) -> Column:
    """The templates that the column ``grams`` matches as a whole."""
    size = F.size("grams")
    tests = []
    for name, g in grams.items():
        bounds = (size >= len(g) * threshold / (2 - threshold)) & (size <= len(g) * (2 - threshold) / threshold)
        dice = 2.0 * F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in g]))) / (size + len(g))
        tests.append(F.when(bounds, F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
    return F.filter(F.array(*tests), lambda t: t["dice"] >= threshold)


def _window_tests(grams: dict[str, list[str]], lengths: dict[str, int], threshold: float) -> Column:
    """The matches of the windows of the column ``pairs``, longer than a window, one for each start."""
    pairs = F.col("pairs")
    texts = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*[F.lit(x) for x in g]).alias("g"), F.lit(lengths[n] - 1).alias("length"), F.lit(_needed(len(g), threshold)).alias("needed")) for n, g in grams.items()])

    def starts(t: Column, hits: Column) -> Column:
        """Where a window begins that has ``needed`` places with a bigram of the template."""
        first = lambda k: F.greatest(hits[k + t["needed"] - 1] - t["length"] + 1, F.lit(0))
        last = lambda k: F.least(hits[k], F.size(pairs) - t["length"])
        near = F.filter(F.sequence(F.lit(0), F.size(hits) - t["needed"]), lambda k: first(k) <= last(k))
        return F.array_distinct(F.flatten(F.transform(near, lambda k: F.sequence(first(k), last(k)))))

    def match(t: Column, window: Column) -> Column:
        dice = 2.0 * F.size(F.array_intersect(window, t["g"])) / (F.size(window) + F.size(t["g"]))
        return F.struct(t["license"].alias("license"), dice.alias("dice"))

    def matches(t: Column) -> Column:
        hits = F.filter(F.transform(pairs, lambda x, i: F.when(F.array_contains(t["g"], x), i)), lambda i: i.isNotNull())
        windows = lambda i: _let(F.array_distinct(F.slice(pairs, i + 1, t["length"])), lambda w: match(t, w))
        return _let(hits, lambda h: F.filter(F.transform(starts(t, h), windows), lambda m: m["dice"] >= threshold))

    can = F.filter(texts, lambda t: (F.size(pairs) > t["length"]) & (F.size(F.array_intersect(F.col("common"), t["g"])) >= t["needed"]))
    return F.flatten(F.transform(can, matches))


def _found(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id", F.col("t.license").alias("license")).agg(F.max("t.dice").alias("dice"), F.count("*").alias("n_units"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row for each document and template that some unit of it matches: doc_id, license, dice (the
    best), n_units (how many units match)."""
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.contains(p, F.lit("\n")))
    grams = {name: g for name, text in templates.items() if (g := _template_bigrams(text))}
    low = min((len(g) * threshold / (2 - threshold) for g in grams.values()), default=0)
    words = anchors(grams, threshold)
    units = docs.filter(_anchored(F.col("text"), words)).select("doc_id", F.explode(F.concat(lines, paragraphs)).alias("unit"))
    units = units.filter(_anchored(F.col("unit"), words))
    units = units.select("doc_id", normalised_words(F.col("unit")).alias("words")).filter(F.size("words") - 1 >= low)
    units = units.select("doc_id", bigrams(F.col("words")).alias("grams"))
    units = units.filter(F.arrays_overlap("grams", F.array(*[F.lit(x) for x in sorted({x for g in grams.values() for x in g})])))
    return _found(units.select("doc_id", F.explode(_unit_tests(grams, threshold)).alias("t")))


def notices(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """As ``scan``, with the whole text and its windows of each template's number of words as units too."""
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.contains(p, F.lit("\n")))
    grams = {name: g for name, text in templates.items() if (g := _template_bigrams(text))}
    lengths = {name: len(_template_words(templates[name])) for name in grams}
    low = min((len(g) * threshold / (2 - threshold) for g in grams.values()), default=0)
    words = anchors(grams, threshold)
    known = F.array(*[F.lit(x) for x in sorted({x for g in grams.values() for x in g})])
    part = F.transform(F.concat(lines, paragraphs), lambda u: F.struct(u.alias("unit"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(F.col("text").alias("unit"), F.lit(True).alias("whole")))
    units = docs.filter(_anchored(F.col("text"), words)).select("doc_id", F.explode(F.concat(part, whole)).alias("u")).select("doc_id", "u.unit", "u.whole")
    units = units.filter(F.col("whole") | _anchored(F.col("unit"), words))
    # An array of one is exploded so that no later filter makes Spark normalise the texts once more.
    units = units.select("doc_id", "whole", F.explode(F.array(normalised_words(F.col("unit")))).alias("words")).filter(F.size("words") - 1 >= low)
    units = units.select("doc_id", "whole", F.explode(F.array(_pairs(F.col("words")))).alias("pairs"))
    units = units.select("doc_id", "whole", "pairs", F.explode(F.array(F.array_intersect("pairs", known))).alias("common")).filter(F.size("common") >= low)
    units = units.select("doc_id", "whole", "pairs", "common", F.explode(F.array(F.array_distinct("pairs"))).alias("grams"))
    inside = F.when(F.col("whole"), _window_tests(grams, lengths, threshold)).otherwise(F.array().cast("array<struct<license:string,dice:double>>"))
    return _found(units.select("doc_id", F.explode(F.concat(_unit_tests(grams, threshold), inside)).alias("t")))
