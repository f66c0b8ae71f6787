"""Licence scans: text units against licence templates, in DataFrame operations only.

The units of a text are its lines, its paragraphs of several lines, and the whole
text, which is compared with whole licences.  Units and templates are normalised (lower case, letters and digits, single spaces) and
compared by the Dice coefficient of their sets of word bigrams.

Size bounds prune twice.  Dice >= t needs sizes within a factor (2 - t) / t, so a
unit is compared only with the templates of fitting size; and a unit shares at
least size * t / (2 - t) bigrams with its template, hence with the union of all
templates, which a hash set in the plan tests first.  The least such number holds for
whole paragraphs already: one that has fewer of the templates' bigrams, or of their
words, has no match in any of its lines or windows and is dropped at once.  All are
lower bounds, so no match is lost.  Everything happens within a row: nothing is
exploded or shuffled.

What no whole line or paragraph matches is searched for notices inside: windows of
a template's length begin at every bigram that some template has.  A window needs
as many such bigrams as above, which their positions tell, again a lower bound.  Of
windows that overlap the best counts.  The SQL knows whole lines, paragraphs and
texts only, and agrees where no text has a notice inside a longer one.

Defined results
    null or empty text   no units, nothing found
    one-word units       no bigrams, never matched
    ties                 the template whose name sorts last among the best; of windows, the longer match first
    repeated rows        one output row each
    null doc_id          scanned like any other row
    very long text       all its lines and paragraphs are units, whole
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_DICE = 0.8

#: Notices and paragraphs of public licences, by name of licence (a part follows the slash).
TEMPLATES = [
    ("Apache-2.0/line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0/grant", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0/warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT/line", "Released under the MIT License."),
    ("MIT/line-2", "Licensed under the MIT License."),
    ("MIT/line-3", "This project is licensed under the terms of the MIT license."),
    ("MIT/grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT/condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT/warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause/grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause/source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause/binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause/endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause/line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD/warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC/warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC/grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0/line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0/line-2", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0/grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0/line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0/grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL/warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0/line", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0/line", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0/notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense/grant", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0/line", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0/line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0/line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0/line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0/line", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0/line", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0/notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0/notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0/notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def _whole_licences() -> list[tuple[str, str]]:
    """Whole licences: the files of ``licence_texts``, and short ones put together from their paragraphs."""
    by = dict(TEMPLATES)
    bsd = ["BSD-2-Clause/grant", "BSD-2-Clause/source", "BSD-2-Clause/binary"]
    made = {
        "MIT": ["MIT/grant", "MIT/condition", "MIT/warranty"],
        "BSD-2-Clause": [*bsd, "BSD/warranty"],
        "BSD-3-Clause": [*bsd, "BSD-3-Clause/endorse", "BSD/warranty"],
        "ISC": ["ISC/grant", "ISC/warranty"],
    }
    texts = [(f"{name}/whole", "\n\n".join(by[p] for p in parts)) for name, parts in made.items()]
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return texts + [(f"{f.stem}/whole", f.read_text(encoding="utf-8")) for f in files]


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)  # normalised words hold no quotes


def _plan(templates: list[tuple[str, str]], t: float) -> tuple[str, str, str, int]:
    """(SQL array of templates, SQL lists of all their bigrams and words, the fewest bigrams that a match shares)."""
    if any(set(name) & set("'\\") for name, _ in templates):
        raise ValueError("names of templates hold no quotes or backslashes")
    made = [(name, template_bigrams(text), len(_words(text)) - 1) for name, text in templates]
    needs = [max(1, math.ceil(len(g) * t / (2 - t) - 1e-9)) for _, g, _ in made]
    rows = [
        f"named_struct('name', '{n}', 'grams', array({_quoted(g)}), 'len', {k}, 'need', {need})"
        for (n, g, k), need in zip(made, needs)
    ]
    every = sorted({x for _, g, _ in made for x in g})
    known = sorted({w for _, text in templates for w in _words(text)})
    return f"array({', '.join(rows)})", _quoted(every), _quoted(known), min(needs)


def _able(words: str, every: str, known: str, need: int) -> str:
    """SQL: whether a word array has as many of the templates' words and bigrams as any match needs."""
    grams = f"transform(sequence(1, size({words}) - 1), i -> concat({words}[i - 1], ' ', {words}[i]))"
    enough = f"size(filter({words}, x -> x in ({known}))) > {need} and size(filter({grams}, b -> b in ({every}))) >= {need}"
    return f"size({words}) > {need} and {enough}"


def _matches(units: str, arrays: str, every: str, t: float) -> str:
    """SQL: (dice, name) of the best template of every matching unit, from an array of word arrays."""
    ratio = t / (2 - t)
    grams = "array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))"
    pairs = f"transform({units}, w -> {grams})"
    likely = f"filter({pairs}, g -> size(filter(g, b -> b in ({every}))) >= size(g) * {ratio!r}D)"
    fitting = (
        f"filter({arrays}, p -> size(p.grams) >= size(g) * {ratio!r}D and size(p.grams) * {ratio!r}D <= size(g))"
    )
    scored = (
        f"transform({fitting}, p -> named_struct('dice', "
        "2.0D * size(array_intersect(g, p.grams)) / (size(g) + size(p.grams)), 'name', p.name))"
    )
    best = f"transform({likely}, g -> array_max({scored}))"
    return f"filter({best}, m -> m.dice >= {t!r}D)"


def _unit(text: str) -> str:
    """SQL: an array of the text's words, empty if it has no bigram."""
    return f"filter(array(filter(split({text}, '[ \n]+'), x -> x != '')), x -> size(x) > 1)"


def _judged(paragraphs: str, arrays: str, every: str, t: float) -> str:
    """SQL: per paragraph its lines (l) with their matches (m), and its own matches (m) if it has several lines."""
    lines = f"transform(split(u, '\n'), l -> named_struct('l', l, 'm', {_matches(_unit('l'), arrays, every, t)}))"
    own = f"if(contains(u, '\n'), {_matches(_unit('u'), arrays, every, t)}, cast(array() as array<struct<dice:double,name:string>>))"
    return f"transform({paragraphs}, u -> named_struct('lines', {lines}, 'm', {own}))"


def _windows(judged: str, arrays: str, every: str, need: int, t: float) -> str:
    """SQL: (dice, name) of the best windows that don't overlap, in what no whole line or paragraph matches."""
    grams = "transform(sequence(1, size(v) - 1), k -> concat(v[k - 1], ' ', v[k]))"
    left = "array_join(transform(q.lines, y -> if(size(y.m) > 0, '\f', y.l)), '\n')"
    runs = f"flatten(transform({judged}, q -> if(size(q.m) > 0, cast(array() as array<string>), split({left}, '\f'))))"
    listed = f"transform(flatten(transform({runs}, r -> {_unit('r')})), v -> {grams})"
    hits = f"transform({listed}, y -> named_struct('y', y, 'h', filter(sequence(0, size(y) - 1), k -> y[k] in ({every}))))"
    fitting = f"filter({arrays}, p -> get(s.h, j + p.need - 1) - s.h[j] < p.len)"
    cut = f"transform({fitting}, p -> named_struct('p', p, 'd', array_distinct(slice(s.y, s.h[j] + 1, p.len))))"
    shared = f"transform({cut}, c -> named_struct('p', c.p, 'size', size(c.d), 'n', size(array_intersect(c.d, c.p.grams))))"
    scored = (
        f"transform({shared}, c -> named_struct('dice', 2.0D * c.n / (c.size + size(c.p.grams)), 'n', c.n, 'name', c.p.name, "
        "'at', -s.h[j], 'end', least(s.h[j] + c.p.len, size(s.y))))"
    )
    good = f"filter(flatten(transform(sequence(0, size(s.h) - 1), j -> {scored})), m -> m.dice >= {t!r}D)"
    none = "array<struct<dice:double,n:int,name:string,at:int,end:int>>"
    apart = (
        f"aggregate(sort_array({good}, false), cast(array() as {none}), "
        "(taken, m) -> if(exists(taken, o -> -o.at <= m.end and -m.at <= o.end), taken, array_append(taken, m)))"
    )
    return (
        f"transform(flatten(transform(filter({hits}, s -> size(s.h) >= {need}), s -> {apart})), "
        "m -> named_struct('dice', m.dice, 'name', m.name))"
    )


def licence_report(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    min_dice: float = MIN_DICE,
    wholes: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_matches, licences (names without parts, sorted, comma-joined), best_template, best_dice.

    A text that holds a notice twice counts it twice in n_matches; a text that is a whole licence counts it too.
    """
    arrays, every, known, need = _plan(templates or TEMPLATES, min_dice)
    whole_arrays, whole_every, whole_known, whole_need = _plan(wholes or WHOLES, min_dice)
    text = F.lower(F.coalesce(F.col("`text`").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ").alias("norm"),
    )

    def words(unit: Column) -> Column:
        return F.filter(F.split(unit, r"[ \n]+"), lambda w: w != "")

    split = "filter(split(u, '[ \n]+'), x -> x != '')"
    parts = F.expr(f"filter(split(norm, '\\n ?\\n[ \\n]*'), u -> exists(array({split}), w -> {_able('w', every, known, need)}))")
    whole = F.filter(F.array(words(F.col("norm"))), lambda w: F.size(w) > whole_need)
    rows = rows.select("doc_id", parts.alias("parts"), whole.alias("whole"))
    able = F.expr(f"filter(whole, w -> {_able('w', whole_every, whole_known, whole_need)})")
    judged = F.expr(_judged("parts", arrays, every, min_dice))
    rows = rows.select("doc_id", judged.alias("judged"), able.alias("whole"))
    found = F.concat(
        F.expr("flatten(transform(judged, q -> concat(flatten(transform(q.lines, y -> y.m)), q.m)))"),
        F.expr(_windows("judged", arrays, every, need, min_dice)),
        F.expr(_matches("whole", whole_arrays, whole_every, min_dice)),
    )
    rows = rows.select("doc_id", found.alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: F.substring_index(m["name"], "/", 1))))
    best = F.array_max("found")
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        best["name"].alias("best_template"),
        best["dice"].alias("best_dice"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ",\n    ".join(
        f"({kind}, '{n}', [{_quoted(template_bigrams(x))}])" for kind, made in ((0, TEMPLATES), (1, WHOLES)) for n, x in made
    )
    return rf"""
WITH t(kind, name, grams) AS (VALUES
    {rows}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm
  FROM documents
), u AS (
  SELECT rid, 0 AS kind, unnest(string_split(norm, chr(10))) AS unit FROM d
  UNION ALL
  SELECT rid, 1, norm FROM d
  UNION ALL
  SELECT rid, 0, unit FROM (SELECT rid, unnest(regexp_split_to_array(norm, '\n ?\n[ \n]*')) AS unit FROM d)
  WHERE contains(unit, chr(10))
), w AS (
  SELECT rid, kind, row_number() OVER () AS uid, list_filter(regexp_split_to_array(unit, '[ \n]+'), lambda x: x <> '') AS w FROM u
), g AS (
  SELECT rid, kind, uid, list_distinct([concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))]) AS grams FROM w WHERE len(w) > 1
), s AS (
  SELECT rid, uid, name, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON g.kind = t.kind AND 3 * len(t.grams) >= 2 * len(g.grams) AND 3 * len(g.grams) >= 2 * len(t.grams)
), m AS (
  SELECT rid, uid, name, dice FROM s WHERE dice >= 0.8
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, name DESC) = 1
), a AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT split_part(name, '/', 1), ',' ORDER BY split_part(name, '/', 1)) AS licences,
         max(dice) AS dice
  FROM m GROUP BY rid
), b AS (
  SELECT rid, name FROM m QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dice DESC, name DESC) = 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences,
       name AS best_template, dice AS best_dice
FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)
"""


WHOLES = _whole_licences()

QUERIES = {"op6_licences": op6_licences}
ORACLES = {"op6_licences": _oracle()}
