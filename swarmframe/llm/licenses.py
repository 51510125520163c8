"""Licence scan: Dice coefficient over word bigrams of normalised text.

The units of a document are its lines, its sentences, its paragraphs (parted by an empty line),
the text as a whole, and parts of sentences that speak of a licence, as long as the one-line notices: the sentence's end, and what
follows wherever two words stand with which such a notice begins. A unit is normalised (lower case, anything but letters
and digits is one space) and becomes a set of word bigrams. For a threshold t a
template of b bigrams can reach a unit of a bigrams only if
``a*t/(2-t) <= b <= a*(2-t)/t``, and only if ``a*t/(2-t)`` of the unit's bigrams are in some template at all:
one set of all templates' bigrams is looked up, and very few units meet the templates themselves. A one-line notice
is met only by units that have one of its rarest bigrams: it shares ``b*t/(2-t)`` bigrams at least with any unit that it names, so all others but that many are
looked at, the rarest among notices first.

Edge cases: a null or empty text, and a unit of fewer than two words, has no
bigrams and matches nothing; of several matches the one that shares most bigrams is reported (a licence's whole text before the notice
that stands in it), of equal ones that of the higher coefficient, then the first by name (so a tag that continues, as MIT-0's, counts for the listed one), and the best other licence found is its runner-up; texts of any length are scanned whole; repeated rows, and rows without an id, each get their row. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
#: Bounds are this much wider than computed, so that rounding cuts off nothing; the coefficient itself decides.
EDGE = 1e-9

TEXTS = Path(__file__).parent / "license_texts"

NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_END = f"{NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def whole(name: str) -> str:
    return (TEXTS / f"{name}.txt").read_text(encoding="ascii")


def gnu(kind: str, version: str, what: str = "program") -> str:
    """The first paragraph of a program's notice."""
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


def versions(kind: str, number: str) -> list[str]:
    """Notices on one line that name a GNU licence and its version."""
    return [f"This work is licensed under the GNU {kind} Public License, version {number}.", f"Licensed under the GNU {kind} Public License v{number}{'' if '.' in number else '.0'}."]


def unversioned(kind: str) -> list[str]:
    """The same without a version: names of their own, so that no version is read into them."""
    return [f"This work is licensed under the GNU {kind} Public License.", f"Licensed under the GNU {kind} Public License."]


def creative(kind: str, code: str) -> list[str]:
    return [
        f"Licensed under CC {code} 4.0.", f"under CC {code} 4.0", f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
        f"{kind} 4.0 International (CC {code} 4.0)", f"Creative Commons {kind} 4.0 International",
    ]


def gnu_only(kind: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {version} as published by the Free Software Foundation."


#: Notices by which works name their licence, operative paragraphs, and whole texts. A sentence that several
#: of the licences share (as the first one of the BSD licences) names none of them and stands only within whole texts.
TEMPLATES = {
    "AGPL": unversioned("Affero General"),
    "AGPL-3.0": [*versions("Affero General", "3"), whole("AGPL-3.0")],
    "AGPL-3.0-only": [gnu_only("Affero General", "3")],
    "AGPL-3.0-or-later": [gnu("Affero General", "3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "under the Apache 2.0 license", "under the Apache License 2.0", " ".join(APACHE), *APACHE, whole("Apache-2.0")],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{BSD_START} {BSD_END}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", BSD_NAMES, f"{BSD_START} {BSD_NAMES} {BSD_END}"],
    "CC-BY-4.0": creative("Attribution", "BY"),
    "CC-BY-NC-4.0": creative("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-SA-4.0": creative("Attribution-ShareAlike", "BY-SA"),
    "GPL": unversioned("General"),
    "GPL-1.0": [whole("GPL-1.0")],
    "GPL-1.0-or-later": [gnu("General", "1")],
    "GPL-2.0": [*versions("General", "2"), whole("GPL-2.0")],
    "GPL-2.0-only": [gnu_only("General", "2")],
    "GPL-2.0-or-later": [gnu("General", "2")],
    "GPL-3.0": [*versions("General", "3"), whole("GPL-3.0")],
    "GPL-3.0-only": [gnu_only("General", "3")],
    "GPL-3.0-or-later": [gnu("General", "3")],
    "ISC": ["Released under the ISC License.", ISC_GRANT, ISC_END, f"{ISC_GRANT} {ISC_END}"],
    "LGPL": unversioned("Lesser General"),
    "LGPL-2.0": [whole("LGPL-2.0")],
    "LGPL-2.0-only": [gnu_only("Library General", "2", "library")],
    "LGPL-2.0-or-later": [gnu("Library General", "2", "library")],
    "LGPL-2.1": [*versions("Lesser General", "2.1"), whole("LGPL-2.1")],
    "LGPL-2.1-only": [gnu_only("Lesser General", "2.1", "library")],
    "LGPL-2.1-or-later": [gnu("Lesser General", "2.1", "library")],
    "LGPL-3.0": [*versions("Lesser General", "3"), whole("LGPL-3.0")],
    "LGPL-3.0-only": [gnu_only("Lesser General", "3")],
    "LGPL-3.0-or-later": [gnu("Lesser General", "3")],
    "MIT": ["Released under the MIT License.", MIT_GRANT, MIT_NOTICE, MIT_END, f"{MIT_GRANT} {MIT_NOTICE} {MIT_END}"],
    "MPL-2.0": [MPL, f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", whole("MPL-2.0")],
    "Unlicense": [*UNLICENSE, " ".join([*UNLICENSE, NO_WARRANTY, MIT_END.removeprefix(NO_WARRANTY).replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"), "For more information, please refer to <http://unlicense.org/>"])],
}
#: Tags that name a licence by its identifier.
for name in TEMPLATES:
    if "-" in name or name in ("ISC", "MIT", "Unlicense"):
        TEMPLATES[name].append(f"SPDX-License-Identifier: {name}")

#: Words of a notice on one line, at most; such notices also stand inside longer sentences.
NOTICE_WORDS = 14
STOP = "\x01"  # the end of a sentence, in normalised text


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def notices(templates: dict[str, list[str]]) -> list[list[str]]:
    """Words of the one-line notices."""
    return [w for ts in templates.values() for t in ts for w in [template_words(t)] if 1 < len(w) <= NOTICE_WORDS]


def notice_lengths(templates: dict[str, list[str]]) -> list[int]:
    return sorted({len(w) for w in notices(templates)})


def notice_starts(templates: dict[str, list[str]]) -> list[str]:
    """The bigrams with which one-line notices begin."""
    return sorted({f"{w[0]} {w[1]}" for w in notices(templates)})


def rarest(sets: list[list[str]], low: float) -> dict[str, list[int]]:
    """Of each set as many bigrams as a unit can not all lack if it shares the least part ``low``; bigram to places in ``sets``."""
    often = Counter(x for g in sets for x in g)
    found: dict[str, list[int]] = {}
    for i, g in enumerate(sets):
        for x in sorted(g, key=lambda x: (often[x], x))[: len(g) - max(1, math.ceil(low * len(g) - EDGE)) + 1]:
            found.setdefault(x, []).append(i)
    return found


def normalised(text: Column) -> Column:
    ends = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?]+[\"')]*([ \t\n\r\f])", STOP + "$1")
    return F.regexp_replace(F.regexp_replace(ends, rf"[^\p{{L}}\p{{N}}\n{STOP}]+", " "), rf" ?([\n{STOP}])[ {STOP}]*", "$1")


def units(t: Column, lengths: list[int], starts: list[str]) -> Column:
    """Lines, sentences, paragraphs and whole of a normalised text, and the notices' lengths of sentences that speak of a licence, at their ends and where a notice may begin, each once."""
    flat = F.regexp_replace(t, rf"[\n{STOP}]+", " ")
    # no blank stands beside an end of a line or sentence, so outside the whole text only one sequence makes two
    plain = lambda x: F.trim(F.translate(F.replace(x, F.lit(STOP + "\n"), F.lit(" ")), STOP + "\n", "  "))
    blocks = F.split(t, "\n\n+")
    sentences = F.flatten(F.transform(blocks, lambda p: F.split(p, STOP)))
    spoken = F.transform(F.filter(sentences, lambda x: F.contains(x, F.lit("licens"))), lambda x: F.split(plain(x), " "))
    ends = F.flatten(F.transform(spoken, lambda w: F.array(*[F.when(F.size(w) > n, F.array_join(F.slice(w, -n, n), " ")) for n in lengths])))
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)).isin(starts))
    # each stretch once before it is taken at all lengths, so that a notice repeated over a whole text is little
    heads = F.array_distinct(F.flatten(F.transform(spoken, lambda w: F.transform(begins(w), lambda i: F.array_join(F.slice(w, i + 1, NOTICE_WORDS), " ")))))
    inside = F.flatten(F.transform(F.transform(heads, lambda h: F.split(h, " ")), lambda w: F.array(*[F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " ")) for n in lengths])))
    return F.array_distinct(F.concat(F.transform(F.concat(F.split(t, "\n"), sentences, blocks), plain), F.array(F.trim(flat)), F.array_compact(F.concat(ends, inside))))


def bigram_set(words: Column) -> Column:
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, pairs), F.slice(words, 2, pairs), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (null if none), dice, n_matches (unit and template pairs), licenses (all names found), runner_up (the best other name, null if none)."""
    templates = templates or TEMPLATES
    listed = [(name, g) for name in sorted(templates) for t in templates[name] if (g := template_bigrams(t))]
    low, high = threshold / (2 - threshold) - EDGE, (2 - threshold) / threshold + EDGE
    least, most = min(len(g) for _, g in listed) * low, int(max(len(g) for _, g in listed) * high)
    cut = 3 * most  # words that a long unit is parted into at first; the last of them is its rest

    def may_fit(words: Column) -> Column:
        """Exact: a unit has fewer bigrams than words, and no fewer distinct ones than any part of it."""
        return (F.size(words) > least) & ((F.size(words) < cut) | (F.size(bigram_set(F.slice(words, 1, cut - 1))) <= most))

    def rest(words: Column) -> Column:
        return F.when(F.size(words) < cut, words).otherwise(F.concat(F.slice(words, 1, cut - 1), F.split(words[cut - 1], " ")))

    short = [(name, g) for name, g in listed if len(g) < NOTICE_WORDS]
    index = rarest([g for _, g in short], low)
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    numbers = F.expr(f"map({', '.join(f"'{x}', array({', '.join(map(str, at))})" for x, at in index.items())})") if index else None
    notice = F.expr(f"array({', '.join(f'array({quoted(g)})' for _, g in short)})")
    names = F.expr(f"array({quoted(name for name, _ in short)})")

    def hit(g: Column, t: Column, size: Column, name: Column) -> Column:
        both = F.size(F.array_intersect(g, t))
        return F.struct(both.alias("both"), (F.lit(2.0) * both / (F.size(g) + size)).alias("dice"), name.alias("name"))

    def score(g: Column) -> Column:
        """Struct (both, dice, name) of the templates that a unit reaches."""
        found = [F.array_compact(F.array(*[F.when(F.size(g).between(F.lit(len(t) * low), F.lit(len(t) * high)), hit(g, F.split(F.lit("\n".join(t)), "\n"), F.lit(len(t)), F.lit(name))) for name, t in listed if len(t) >= NOTICE_WORDS]))] if len(short) < len(listed) else []
        if index:
            met = F.array_distinct(F.flatten(F.transform(F.filter(g, lambda x: x.isin(list(index))), lambda x: F.element_at(numbers, x))))
            found.append(F.transform(met, lambda i: hit(g, F.get(notice, i), F.size(F.get(notice, i)), F.get(names, i))))
        return F.filter(F.concat(*found), lambda s: s["dice"] >= threshold)

    known = ", ".join(f"'{g}'" for g in sorted({x for _, t in listed for x in t}))
    words = ", ".join(f"'{w}'" for w in sorted({w for _, t in listed for x in t for w in x.split()}))
    # in steps, so that what is used several times is computed once
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    parted = text.select("doc_id", F.transform(units(F.col("t"), notice_lengths(templates), notice_starts(templates)), lambda u: F.split(u, " ", cut)).alias("u"))
    # a word of no template spoils a bigram, which has two words; so of n words 2 (1 - low) n different ones at most may be unknown
    parted = parted.select("doc_id", F.expr(f"filter(u, w -> size(w) >= {cut} OR size(array_distinct(filter(w, x -> x NOT IN ({words})))) <= {2 * (1 - low)!r}D * size(w))").alias("u"))
    sets = parted.select("doc_id", F.filter(F.transform(F.filter("u", may_fit), lambda w: bigram_set(rest(w))), lambda g: F.size(g).between(F.lit(least), F.lit(most))).alias("g"))
    near = sets.select("doc_id", F.expr(f"filter(g, s -> size(filter(s, x -> x IN ({known}))) >= {low!r}D * size(s))").alias("g"))
    found = near.select("doc_id", F.flatten(F.transform("g", score)).alias("m"))
    better = lambda a, x: a.isNull() | (x["both"] > a["both"]) | ((x["both"] == a["both"]) & ((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["name"] < a["name"]))))
    best = lambda rows: F.reduce(rows, F.lit(None).cast("struct<both:int,dice:double,name:string>"), lambda a, x: F.when(better(a, x), x).otherwise(a))
    top = found.withColumn("top", best(F.col("m")))
    return top.select(
        "doc_id", F.col("top.name").alias("license"), F.col("top.dice").alias("dice"), F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["name"]))), ",").alias("licenses"),
        best(F.filter("m", lambda x: x["name"] != F.col("top.name")))["name"].alias("runner_up"),
    )


def op10_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op10_sql() -> str:
    rows = ",\n".join(f"('{name}', '{t.lower().replace(chr(39), chr(39) * 2)}')" for name in sorted(TEMPLATES) for t in TEMPLATES[name])
    lengths, starts = ", ".join(map(str, notice_lengths(TEMPLATES))), ", ".join(f"'{x}'" for x in notice_starts(TEMPLATES))
    return rf"""
WITH given(name, text) AS (VALUES {rows}),
tw AS (SELECT name, text, string_split(trim(regexp_replace(text, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM given),
templates AS (SELECT name, text, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
norm AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?]+["'')]*([ \t\n\r\f])', chr(1) || '\1', 'g'), '[^\p{{L}}\p{{N}}\n\x01]+', ' ', 'g'), ' ?([\n\x01])[ \x01]*', '\1', 'g') AS t FROM documents),
parts AS (
  SELECT r, string_split(t, chr(10)) AS lines, string_split_regex(t, '\n\n+') AS blocks, t FROM norm),
spoken AS (
  SELECT *, flatten(list_transform(blocks, lambda p: string_split(p, chr(1)))) AS sentences FROM parts),
told AS (
  SELECT *, list_transform(list_filter(sentences, lambda x: contains(x, 'licens')), lambda x: string_split(trim(regexp_replace(x, '[ \n\x01]+', ' ', 'g')), ' ')) AS said FROM spoken),
begun AS (
  SELECT *, flatten(list_transform(said, lambda w: list_transform(
    list_filter(range(1, len(w)), lambda i: list_contains([{starts}], w[i] || ' ' || w[i + 1])), lambda i: w[i:i + {NOTICE_WORDS - 1}]))) AS heads FROM told),
unit_lists AS (
  SELECT r, list_distinct(list_concat(
    list_transform(list_concat(lines, sentences, blocks, [t]), lambda u: trim(regexp_replace(u, '[ \n\x01]+', ' ', 'g'))),
    flatten(list_transform(said, lambda w: list_transform(list_filter([{lengths}], lambda n: len(w) > n), lambda n: array_to_string(w[-n:], ' ')))),
    flatten(list_transform(heads, lambda w: list_transform(list_filter([{lengths}], lambda n: len(w) >= n), lambda n: array_to_string(w[:n], ' '))))
  )) AS us FROM begun),
unit_rows AS (SELECT r, string_split(unnest(us), ' ') AS w FROM unit_lists),
sets AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM unit_rows WHERE len(w) > 1),
scored AS (
  SELECT r, name, len(list_intersect(s.g, t.g)) AS n_both, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice
  FROM sets s JOIN templates t ON len(s.g) BETWEEN len(t.g) * {THRESHOLD / (2 - THRESHOLD) - EDGE!r}::DOUBLE AND len(t.g) * {(2 - THRESHOLD) / THRESHOLD + EDGE!r}::DOUBLE),
good AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}::DOUBLE),
hits AS (
  SELECT r, first(name ORDER BY n_both DESC, dice DESC, name) AS license, first(dice ORDER BY n_both DESC, dice DESC, name) AS dice, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM good GROUP BY r),
others AS (SELECT g.r, first(name ORDER BY n_both DESC, g.dice DESC, name) AS runner_up FROM good g JOIN hits h ON g.r = h.r AND name <> license GROUP BY g.r)
SELECT doc_id, license, dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, runner_up
FROM norm LEFT JOIN hits USING (r) LEFT JOIN others USING (r)
"""
