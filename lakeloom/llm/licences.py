"""Licence scans with DataFrame functions only.

A unit of text is normalised to lower-case words of letters and digits. Its set of word bigrams is compared to each template's by
Dice's coefficient, 2 * common / (size + template's size). A coefficient of t or more needs a size between t / (2 - t) and
(2 - t) / t times the template's, so templates outside these bounds are left out before any set is intersected. And it needs at
least the lower bound's number of bigrams in common; where a whole text has fewer, none of its units can have them, so only texts
that have as many of some template are parted into units.

Units are lines, paragraphs, the whole text, and of each template the best run: consecutive sentences and lines, with no more words
than (2 - t) / t times the template's. So a licence of several paragraphs in the middle of a text is found, and a notice inside a
longer line. Of runs of different licences that overlap only the one with the most bigrams in common counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: (template, licence, text). Public texts that must be as they are.
TEMPLATES: list[tuple[str, str, str]] = [
    ("mit_text", "MIT", _MIT),
    ("mit_notice", "MIT", "Released under the MIT License."),
    ("mit_notice_2", "MIT", "Licensed under the MIT License."),
    ("isc_text", "ISC", _ISC),
    ("apache_header", "Apache-2.0", _APACHE),
    ("apache_notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl3_header", "GPL-3.0", _GPL),
    ("gpl2_header", "GPL-2.0", _GPL.replace("version 3", "version 2")),
    ("agpl3_header", "AGPL-3.0", _GPL.replace("General", "Affero General")),
    ("lgpl3_header", "LGPL-3.0", _GPL.replace("General", "Lesser General")),
    ("gpl3_notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl3_notice", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl2_notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd2_text", "BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("bsd3_text", "BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    ("zlib_text", "Zlib", _ZLIB),
    ("unlicense_text", "Unlicense", _UNLICENSE),
    ("bsd_notice", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc_by_notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc_by_sa_notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc_by_nc_notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc_by_text", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0_notice", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """The sorted distinct word bigrams of a template."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Least and greatest number of bigrams that a unit of `percent` or more can have."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def most_words(text: str, percent: int) -> int:
    """The greatest number of words of a run that is compared with a template."""
    return bounds(len(words_of(text)), percent)[1]


def _table(templates: list[tuple[str, str, str]], percent: int) -> str:
    """The templates as an SQL literal, an array of structs."""
    rows = []
    for name, licence, text in templates:
        held = bigrams(text)
        low, high = bounds(len(held), percent)
        rows.append(
            f"named_struct('template', {_quoted(name)}, 'licence', {_quoted(licence)}, 'low', {low}, 'high', {high}, 'words', {most_words(text, percent)}, 'bigrams', array({', '.join(map(_quoted, held))}))"
        )
    return f"array({', '.join(rows)})"


def _let(**names: str) -> str:
    """SQL that evaluates the last expression with each name before it bound to its expression."""
    *bound, (_, body) = names.items()
    for name, value in reversed(bound):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


_PLAIN = r"regexp_replace({}, '[^\\p{{L}}\\p{{N}}\n]+', ' ')"
_WHOLE = r"trim(regexp_replace({}, '[ \n]+', ' '))"


def _units() -> str:
    """From `text` and its normal form `plain`: (unit, body) of its lines, its paragraphs (parted by blank lines) of several lines,
    and the whole; body: the text, for the whole only."""
    part = "named_struct('unit', {}, 'body', cast(null as string))"
    lines = f"transform(if(instr(plain, '\n') > 0, split(plain, '\n'), array()), x -> {part.format('trim(x)')})"
    several = r"filter(split(plain, '\n[ \n]*\n'), x -> instr(trim(' \n' from x), '\n') > 0)"
    paragraphs = f"transform({several}, x -> {part.format(_WHOLE.format('x'))})"
    return f"concat({lines}, {paragraphs}, array(named_struct('unit', {_WHOLE.format('plain')}, 'body', text)))"


def _runs(percent: int) -> str:
    """From `body` and templates `ts`: (unit, template, licence, common, total) of the best run of each, but for those that overlap
    a better one of another licence.

    The best run is that of the greatest coefficient; of several the one of fewest words, then the first. So it starts with a
    sentence that holds the beginning of a bigram of the template; and from this bigram on it holds `low` of them or more. Only such
    starts are looked at.
    """
    ends = "filter(sequence(a, cast(least(a + t.words, size(w)) - 1 as int)), e -> e > a and (e = size(w) - 1 or seg[e + 1] <> seg[e]))"
    run = _let(
        h="array_distinct(slice(g, a + 1, e - a))",
        both="size(array_intersect(h, t.bigrams))",
        out="named_struct('d', -2D * both / (size(h) + size(t.bigrams)), 'long', e - a, 'a', a, 'e', e, 'common', both, 'total', size(h) + size(t.bigrams), 'template', t.template, 'licence', t.licence)",
    )
    best = _let(
        hit="filter(sequence(0, size(g) - 1), k -> array_contains(t.bigrams, g[k]))",
        starts="array_distinct(transform(filter(hit, (p, x) -> x + t.low - 1 < size(hit) and hit[x + t.low - 1] - p < t.words), p -> cast(array_position(seg, seg[p]) - 1 as int)))",
        out=f"array_min(flatten(transform(starts, a -> transform({ends}, e -> {run}))))",
    )
    key = "named_struct('common', -{0}.common, 'd', {0}.d, 'licence', {0}.licence, 'template', {0}.template)"
    better = f"y.licence <> x.licence and y.a <= x.e and x.a <= y.e and {key.format('y')} < {key.format('x')}"
    return _let(
        s=f"""filter(transform(split({_PLAIN.format(r"regexp_replace(lower(body), '[.!?;:]+[ \t\r\n]', '\n')")}, '\n'), x -> trim(x)), x -> x <> '')""",
        w="flatten(transform(s, x -> split(x, ' ')))",
        seg="flatten(transform(s, (x, i) -> array_repeat(i, size(split(x, ' ')))))",
        g="transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))",
        found=f"filter(transform(ts, t -> {best}), x -> x is not null and 200 * x.common >= {percent} * x.total)",
        out=f"transform(filter(found, x -> not exists(found, y -> {better})), x -> named_struct('unit', array_join(slice(w, x.a + 1, x.e - x.a + 1), ' '), 'template', x.template, 'licence', x.licence, 'common', x.common, 'total', x.total))",
    )


def _once(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with new columns; exploding a single array keeps what it holds from being computed again at each use."""
    for name, value in columns.items():
        rows = rows.select("*", F.explode(F.array(F.expr(value))).alias(name))
    return rows


def scan(docs: DataFrame, percent: int = 80, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, licence, template, dice, units): for each document and licence the best template, its greatest coefficient, and
    the number of different units (normalised) whose best licence it is. A unit counts for the licence of its greatest coefficient,
    percent / 100 or more, only.

    Ties between licences, then templates, go to the first by name. Texts of any length are read whole. Rows that share a doc_id count as one document; a null doc_id is one too.
    Null, empty or one-word texts have no bigrams and match nothing; an empty table gives an empty table; other columns are
    ignored. Documents without a licence have no row.
    """
    least = min(bounds(len(bigrams(t)), percent)[0] for _, _, t in templates)
    every = ", ".join(map(_quoted, sorted({g for _, _, t in templates for g in bigrams(t)})))
    table = _table(templates, percent)
    grams = "array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))"

    def sets(rows: DataFrame) -> DataFrame:
        """rows with b, the bigrams of `unit`. It has one blank fewer than words, and no more bigrams than blanks."""
        held = rows.where(F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) >= least)
        return _once(held, w="split(unit, ' ')", b=grams).drop("w")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = sets(_once(texts, plain=_PLAIN.format("lower(text)"), unit=_WHOLE.format("plain")))
    known = _once(whole, h=f"array_intersect(b, array({every}))").select("doc_id", "text", "plain", "h")
    within = f"filter({table}, t -> size(h) >= t.low and size(array_intersect(h, t.bigrams)) >= t.low)"
    likely = _once(known, names=f"transform({within}, t -> t.template)").where("size(names) > 0")
    units = sets(likely.select("doc_id", "names", F.explode(F.expr(_units())).alias("u")).select("doc_id", "names", "u.unit", "u.body"))
    near = f"filter({table}, t -> size(b) between t.low and t.high)"
    alone = f"transform({near}, t -> named_struct('unit', unit, 'template', t.template, 'licence', t.licence, 'common', size(array_intersect(b, t.bigrams)), 'total', size(b) + size(t.bigrams)))"
    runs = _let(ts=f"filter({table}, t -> array_contains(names, t.template))", out=_runs(percent))
    compared = units.select("doc_id", F.explode(F.expr(f"concat({alone}, if(body is null, array(), {runs}))")).alias("m"))
    hits = compared.where(f"200 * m.common >= {percent} * m.total").select("doc_id", "m.unit", "m.licence", "m.template", (F.lit(2.0) * F.col("m.common") / F.col("m.total")).alias("dice"))
    # of one unit only the best licence counts: a notice of one is near that of its kin
    first = F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence").alias("l"), F.col("template").alias("t"))).alias("x")
    hits = hits.groupBy("doc_id", "unit").agg(first).select("doc_id", "unit", F.col("x.l").alias("licence"), F.col("x.t").alias("template"), (-F.col("x.d")).alias("dice"))
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("template").alias("t")))
    found = hits.groupBy("doc_id", "licence").agg(best.alias("best"), F.count_distinct("unit").alias("units"))
    return found.select("doc_id", "licence", F.col("best.t").alias("template"), (-F.col("best.d")).alias("dice"), "units")


def oracle(percent: int = 80, templates: list[tuple[str, str, str]] = TEMPLATES) -> str:
    """The scan of documents as DuckDB SQL."""
    rows = ", ".join(f"({_quoted(n)}, {_quoted(licence)}, {_quoted(text)})" for n, licence, text in templates)
    normal = r"regexp_replace({}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return rf"""
WITH t AS (SELECT template, licence, {grams} AS tb, len(w) * (200 - {percent}) // {percent} AS words FROM (SELECT template, licence, string_split(trim(regexp_replace({normal.format("lower(body)")}, '[ \n]+', ' ', 'g')), ' ') AS w
      FROM (VALUES {rows}) v(template, licence, body))),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT doc_id, {normal.format("lower(text)")} AS plain FROM d),
u AS (SELECT DISTINCT doc_id, unit FROM (
      SELECT doc_id, trim(unnest(string_split(plain, chr(10)))) AS unit FROM p
      UNION ALL SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(plain, '\n[ \n]*\n')), '[ \n]+', ' ', 'g')) FROM p
      UNION ALL SELECT doc_id, trim(regexp_replace(plain, '[ \n]+', ' ', 'g')) FROM p)),
s AS (SELECT doc_id, unit, {grams} AS b FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u) WHERE len(w) > 1),
m AS (SELECT doc_id, unit, licence, template, len(list_intersect(b, tb)) AS common, len(b) + len(tb) AS total FROM s JOIN t
      ON len(b) * (200 - {percent}) >= len(tb) * {percent} AND len(b) * {percent} <= len(tb) * (200 - {percent})),
g AS (SELECT r, doc_id, list_filter([trim(x) for x in string_split({normal.format(r"regexp_replace(lower(text), '[.!?;:]+[ \t\r\n]', chr(10), 'g')")}, chr(10))], lambda x: x <> '') AS segs FROM d),
w AS (SELECT r, doc_id, flatten([string_split(x, ' ') for x in segs]) AS w, flatten(list_transform(segs, lambda x, i: [i for y in string_split(x, ' ')])) AS seg FROM g),
c AS (SELECT r, doc_id, w, seg, template, licence, tb, words FROM w JOIN t ON len(list_intersect({grams}, tb)) * (200 - {percent}) >= len(tb) * {percent}),
a AS (SELECT *, unnest([i for i in range(1, len(w) + 1) if i = 1 or seg[i] <> seg[i - 1]]) AS a FROM c),
e AS (SELECT *, unnest([j for j in range(a + 1, least(a + words, len(w) + 1)) if j = len(w) or seg[j] <> seg[j + 1]]) AS e FROM a),
k AS (SELECT r, doc_id, template, licence, a, e, array_to_string(w, ' ') AS unit, {grams} AS b, tb FROM (SELECT * REPLACE (w[a:e] AS w) FROM e)),
q AS (SELECT *, len(list_intersect(b, tb)) AS common, len(b) + len(tb) AS total FROM k),
b AS (SELECT r, doc_id, template, licence, a, e, unit, common, total, 2.0::DOUBLE * common / total AS dice FROM q WHERE 200 * common >= {percent} * total
      QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY 2.0::DOUBLE * common / total DESC, e - a, a) = 1),
x AS (SELECT doc_id, unit, licence, template, common, total FROM b WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.r = b.r AND y.licence <> b.licence AND y.a <= b.e AND b.a <= y.e
      AND (-y.common, -y.dice, y.licence, y.template) < (-b.common, -b.dice, b.licence, b.template))),
h AS (SELECT doc_id, unit, licence, template, 2.0::DOUBLE * common / total AS dice FROM (SELECT * FROM m UNION ALL SELECT * FROM x) WHERE 200 * common >= {percent} * total),
o AS (SELECT doc_id, unit, licence, template, dice FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence, template) AS first FROM h) WHERE first = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, template) AS k, dense_rank() OVER (PARTITION BY doc_id, licence ORDER BY unit) AS d FROM o)
SELECT doc_id, licence, max(template) FILTER (k = 1) AS template, max(dice) AS dice, max(d) AS units FROM r GROUP BY doc_id, licence
"""
