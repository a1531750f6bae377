import re

from vertexloom.llm import licenses

MIT = licenses.TEMPLATES["MIT text"]
ROWS = [(1, "Released under the MIT License."), (2, "x y z\nreleased  UNDER the mit license\nmore"), (3, f"prose here\n\n{MIT[:300]}\n{MIT[300:]}\n\nend"), (4, "released under the license"), (5, ""), (6, None)]
ROWS += [(None, "Licensed under CC BY 4.0."), (1, "Released under the MIT License."), (7, "license " * 30_000), (8, "a\n" * 3000 + "This program is free software"), (9, "Licensed under the Apache License, Version 2")]


def units(text):
    return text.split("\n") + [p for p in re.split(r"\n\s*\n", text) if "\n" in p]


def grams(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return set(zip(w, w[1:]))


def brute(threshold=0.8):
    out = {}
    for d, text in ROWS:
        for u in units(text or ""):
            a = grams(u)
            for name, t in licenses.TEMPLATES.items():
                b = grams(t)
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= threshold:
                    best, n = out.get((d, name), (0, 0))
                    out[d, name] = max(best, dice), n + 1
    return {(*k, round(v[0], 9), v[1]) for k, v in out.items()}


def test_equals_brute_force(spark, nothing):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, unit int, dice int").repartition(3)
    for threshold in (0.8, 0.6):
        got = licenses.scan(df, threshold=threshold).collect()
        assert {(r["doc_id"], r["license"], round(r["dice"], 9), r["n_units"]) for r in got} == brute(threshold)
    assert licenses.scan(nothing).count() == 0


def test_every_match_has_an_anchor():
    g = {n: licenses._template_bigrams(t) for n, t in licenses.TEMPLATES.items()}
    words = licenses.anchors(g, 0.8)
    for bigrams in g.values():
        without = [x for x in bigrams if not any(licenses._in(a, w) for a in words for w in x.split())]
        assert len(without) < len(bigrams) * 0.8 / 1.2


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps")], "doc_id long, text string")
    got = licenses.scan(df, {"fox": "The quick, brown fox jumps!", "none": "", "one": "word"}).collect()
    assert [tuple(r) for r in got] == [(1, "fox", 1.0, 1)]


BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

#     http://www.apache.org/licenses/LICENSE-2.0

# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
PADDED = "one two three " * 40
LAYOUTS = [(20, BSD, "BSD-2-Clause"), (21, GPL, "GPL-3.0 header"), (22, APACHE, "Apache-2.0 header"), (23, f"{PADDED}{BSD}\n\n{PADDED}", "BSD-2-Clause"), (24, f"{PADDED}released under the MIT License, {PADDED}", "MIT")]


def brute_notices(rows, threshold=0.8):
    out = {}
    for d, text in rows:
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        for name, t in licenses.TEMPLATES.items():
            b, n = grams(t), len(re.sub(r"[\W_]+", " ", t).split())
            each = [grams(u) for u in [*units(text or ""), text or ""]] + [set(zip(w[i : i + n], w[i + 1 : i + n])) for i in range(len(w) - n + 1) if len(w) > n]
            dices = [x for a in each if (x := 2 * len(a & b) / (len(a) + len(b))) >= threshold]
            if dices:
                best, k = out.get((d, name), (0, 0))
                out[d, name] = max(best, *dices), k + len(dices)
    return {(*k, round(v[0], 9), v[1]) for k, v in out.items()}


def test_notices_in_their_usual_layout(spark, nothing):
    rows = ROWS + [r[:2] for r in LAYOUTS] + [(25, f"{MIT} " * 5), (26, MIT.replace("Software", "Program")), (27, "released under the mit " * 50)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, unit int, whole int").repartition(3)
    for threshold in (0.8, 0.6):
        got = licenses.notices(df, threshold=threshold).collect()
        assert {(r["doc_id"], r["license"], round(r["dice"], 9), r["n_units"]) for r in got} == brute_notices(rows, threshold)
    found = {(r["doc_id"], r["license"]) for r in licenses.notices(df).collect()}
    lines = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    assert {(d, name) for d, _, name in LAYOUTS} <= found - lines
    assert lines <= found
    assert licenses.notices(nothing).count() == 0
