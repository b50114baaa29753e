"""Licence scan: lines and passages of normalised text against licence templates by Dice coefficient over word bigrams.

Only DataFrame expressions; no shuffle. A line or a window of words A matches a template B if 2 |A and B| / (|A| + |B|) reaches the
threshold t over distinct bigrams. That implies t/(2-t) |B| <= |A| <= (2-t)/t |B|, which prunes templates by size,
and |A and B| >= t/(2-t) |B|, so a match holds at least one bigram of each large enough subset of B's:
``anchors`` chooses few words that leave fewer bigrams without them, and only texts and lines with such a word are looked at.

Windows run over the whole text, so a notice may be wrapped, stand in a line with other words, or have lost some of its own; what tells two licences apart by a word is left to the better template. Runs are
the text's longest stretches of bigrams that B has. A window is as good at least as any other one within if it begins where a run begins
and ends where one ends: what B hasn't got at its ends makes it worse, and more of what B has never does. So only such windows
are rated, those with enough of B's bigrams and at most twice B's length.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import DataFrame, functions as F

# Wording of public licence notices and of whole licences.
_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CONDITIONS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
TEMPLATES = {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
    "This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
    "either version 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": _CONDITIONS_BSD + _WARRANTY_BSD,
    "BSD-3-Clause-text": _CONDITIONS_BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _WARRANTY_BSD,
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
    "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
    "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
    "distribution.",
}
THRESHOLD = 0.75
#: Words up to this length are looked for as whole words, others anywhere.
SHORT = 4
# Short words that most English texts have.
_COMMON = frozenset("a an and any are as at be by do for if in is it no not of on or out shall so the this to use with you".split())


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).split()


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words, chosen greedily, so that fewer than the needed bigrams of each template are without one of them."""
    ratio, chosen = threshold / (2 - threshold), []
    while True:
        open_ = {}
        for name, grams in templates.items():
            free = [g for g in grams if not set(g.split()) & set(chosen)]
            if free and len(free) >= ratio * len(grams) - 1e-9:
                open_[name] = free
        if not open_:
            return chosen
        gain: dict[str, float] = {}
        for free in open_.values():
            for g in free:
                for w in g.split():
                    gain[w] = gain.get(w, 0) + (len(w) ** 2 if len(w) > SHORT else 0.01 if w not in _COMMON and not w.isdigit() else 0.001)
        chosen.append(max(sorted(gain), key=gain.get))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each match: id, line_no (from 1, where it begins), license, shared (bigrams), dice.

    The best template of a line counts, of equal ones the first by name. Added are passages: of each template and each start of a
    run the best window (the most shared bigrams, then the shortest), of overlapping ones the best one. A passage
    that touches a matching line is left out if that line has the same template, or one that is as good (by dice, then
    shared). Null, empty and one-word texts match nothing; repeated rows are scanned one by one; very long texts are
    scanned as a whole, one row each, in time that grows with their length (and with the square of a template's, so templates are
    notices and short licences); other columns are ignored; an empty table gives none.
    """
    texts_of = templates or TEMPLATES
    grams = {name: bigrams(t) for name, t in sorted(texts_of.items())}
    grams = {name: g for name, g in grams.items() if g}
    words = anchors(grams, threshold)
    ratio = threshold / (2 - threshold)

    def once(value, use):
        """use(value), with value worked out once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def holds(column):
        def any_word(low):
            out = F.lit(False)
            for w in words:
                # lower-casing may turn other letters into a-z, so whole words are told on the text itself
                out = out | (F.contains(low, F.lit(w)) if len(w) > SHORT else column.rlike(f"(?i)(?:^|[^a-z0-9]){w}(?:$|[^a-z0-9])"))
            return out

        return F.coalesce(once(F.lower(column), any_word), F.lit(False))

    def normal(column):
        plain = F.regexp_replace(F.translate(column, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+", " ")
        return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")

    def pairs(w):
        return F.when(F.size(w) >= 2, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))

    # one constant: number, bigrams, how many of them a match shares at least, how many positions it has at most
    known = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(len(g)).alias("n"), F.lit(math.ceil(ratio * len(g) - 1e-9)).alias("least"), F.lit(2 * (len(normal_words(texts_of[name])) - 1)).alias("most"), F.split(F.lit(",".join(g)), ",").alias("grams"))
            for k, (name, g) in enumerate(grams.items())
        ]
    )

    def line_match(line):
        def best(g):
            n = F.size(g)

            def rate(t):
                near = (n >= ratio * t["n"] - 1e-9) & (n <= t["n"] / ratio + 1e-9)
                return F.when(near, once(F.size(F.array_intersect(g, t["grams"])), lambda shared: F.struct((2.0 * shared / (n + t["n"])).alias("dice"), (-t["k"]).alias("k"), shared.alias("shared"), line["no"].alias("line"))))

            return F.array_max(F.filter(F.transform(known, rate), lambda m: m["dice"] >= threshold))

        return once(F.array_distinct(pairs(line["w"])), best)

    def windows(t):
        """Of each run of template t's bigrams: the best window from there on, if it matches."""

        def window(i, j):
            def rate(part):
                return once(F.size(F.array_intersect(part, t["grams"])), lambda shared: F.struct((2.0 * shared / (F.size(F.array_distinct(part)) + t["n"])).alias("dice"), shared.alias("shared"), (-j).alias("end")))

            return once(F.slice("_g", i + 1, j - i + 1), rate)

        def best(runs):
            def of(r, x):
                enough = lambda e: (e["end"] - r["start"] < t["most"]) & (e["before"] + e["n"] - r["before"] >= t["least"])
                ends = F.filter(F.slice(runs, x + 1, F.shiftright(t["most"], 1) + 1), enough)
                found = F.array_max(F.transform(ends, lambda e: window(r["start"], e["end"])))
                return once(found, lambda b: F.when(b["dice"] >= threshold, F.struct((-b["dice"]).alias("worse"), (-b["shared"]).alias("fewer"), r["start"].alias("start"), t["k"].alias("k"), (-b["end"]).alias("end"))))

            return F.filter(F.transform(runs, of), lambda c: c.isNotNull())

        def runs(hits):
            def between(first):
                def run(i, x):
                    n = F.coalesce(F.get(first, x + 1), F.size(hits)) - i
                    return F.struct(F.get(hits, i).alias("start"), (F.get(hits, i) + n - 1).alias("end"), i.alias("before"), n.alias("n"))

                return F.transform(first, run)

            return once(F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: (i == 0) | (F.get(hits, i) - F.get(hits, i - 1) > 1)), between)

        hits = F.filter(F.transform("_g", lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        return F.when(F.size(F.array_intersect("_d", t["grams"])) >= t["least"], once(once(hits, runs), best))

    def chosen(found):
        """Of candidates by start: apart from those that overlap none, the best ones of each chain of overlaps."""
        apart = lambda a, b: (a["start"] > b["end"] + 1) | (b["start"] > a["end"] + 1)
        none = F.slice(found, 1, 0)

        def chain(at, c):
            new = c["start"] > at["last"] + 1
            return F.struct(
                F.when(new, F.concat(at["done"], F.array(at["open"]))).otherwise(at["done"]).alias("done"), F.when(new, F.array(c)).otherwise(F.concat(at["open"], F.array(c))).alias("open"),
                F.when(new, c["end"]).otherwise(F.greatest(at["last"], c["end"])).alias("last"),
            )

        chains = F.aggregate(found, F.struct(F.slice(F.array(none), 1, 0).alias("done"), none.alias("open"), F.lit(-2).alias("last")), chain, lambda at: F.concat(at["done"], F.array(at["open"])))
        pick = lambda c: F.aggregate(F.array_sort(c), none, lambda done, x: F.when(F.exists(done, lambda d: ~apart(x, d)), done).otherwise(F.concat(done, F.array(x))))
        return F.flatten(F.transform(chains, lambda c: F.when(F.size(c) < 2, c).otherwise(pick(c))))

    lines = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct((i + 1).alias("no"), normal(line).alias("w"), holds(line).alias("held")))
    texts = docs.where(holds(F.col(text))).select(id_col, lines.alias("_lines"))
    at = F.flatten(F.transform("_lines", lambda x: F.transform(x["w"], lambda _: x["no"])))
    texts = texts.select(id_col, F.transform("_lines", lambda x: F.when(x["held"], line_match(x))).alias("_m"), at.alias("_at"), pairs(F.flatten(F.transform("_lines", lambda x: x["w"]))).alias("_g"))

    def candidates(d):
        found = F.transform(known, lambda t: F.coalesce(windows(t), F.array().cast("array<struct<worse:double,fewer:int,start:int,k:int,end:int>>")))
        return F.transform(F.array_sort(F.transform(F.flatten(found), lambda c: F.struct(c["start"].alias("at"), c.alias("c")))), lambda x: x["c"])

    texts = texts.withColumn("_d", F.array_distinct("_g"))
    texts = texts.select(id_col, "_m", "_at", once(F.col("_d"), candidates).alias("_c"))
    placed = F.transform(once(F.col("_c"), chosen), lambda c: F.struct((-c["worse"]).alias("dice"), (-c["k"]).alias("k"), (-c["fewer"]).alias("shared"), F.element_at("_at", c["start"] + 1).alias("line"), F.element_at("_at", c["end"] + 2).alias("last")))
    told = lambda m, c: m.isNotNull() & ((m["k"] == c["k"]) | (m["dice"] > c["dice"]) | ((m["dice"] == c["dice"]) & (m["shared"] >= c["shared"])))
    texts = texts.select(id_col, "_m", placed.alias("_p"))
    new = F.filter("_p", lambda c: ~F.exists(F.slice("_m", c["line"], c["last"] - c["line"] + 1), lambda m: told(m, c)))
    new = F.transform(new, lambda c: F.struct(c["dice"].alias("dice"), c["k"].alias("k"), c["shared"].alias("shared"), c["line"].alias("line")))
    names = F.array(*[F.lit(x) for x in grams])
    # outer, as Spark would work out the lists of explode twice, to filter empty ones first
    best = texts.select(id_col, F.explode_outer(F.concat(F.filter("_m", lambda m: m.isNotNull()), new)).alias("_b")).where(F.col("_b").isNotNull())
    return best.select(id_col, F.col("_b.line").alias("line_no"), F.element_at(names, 1 - F.col("_b.k")).alias("license"), F.col("_b.shared").alias("shared"), F.col("_b.dice").alias("dice"))


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The lines of ``scan`` for DuckDB over documents, without anchors and size bounds; its passages are not in SQL."""
    values = ", ".join(f"('{name}', '{g}', {len(gs)})" for name, t in sorted((templates or TEMPLATES).items()) if (gs := bigrams(t)) for g in gs)
    return f"""
WITH t(license, gram, n_b) AS (VALUES {values}),
l AS (SELECT row_number() OVER () AS r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
w AS (SELECT r, doc_id, line_no, string_split(trim(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM l),
g AS (SELECT r, doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
x AS (SELECT r, doc_id, line_no, len(g) AS n_a, unnest(g) AS gram FROM g),
m AS (SELECT x.r, x.doc_id, x.line_no, t.license, CAST(count(*) AS INTEGER) AS shared, 2.0::DOUBLE * count(*) / (any_value(x.n_a) + any_value(t.n_b)) AS dice FROM x JOIN t USING (gram) GROUP BY x.r, x.doc_id, x.line_no, t.license),
b AS (SELECT *, row_number() OVER (PARTITION BY r, line_no ORDER BY dice DESC, license) AS k FROM m WHERE dice >= {threshold})
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, shared, dice FROM b WHERE k = 1"""
