"""URL cascades, mixing and licences: against SQL, plain Python, and edge cases."""

import glob
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import licenses, mixing, queries, url_filter

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    normal = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert normal(df.select(*want.columns).collect()) == normal(want.fetchall())


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(r), r, a) for a, r in rules for h, _, p in [r.partition("/")] if ("." + host).endswith("." + h) and path.startswith("/" + p)]
    _, rule, action = max(fit, default=(0, None, "allow"))
    return host, path, rule, action


URLS = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com/", "http://www.EXAMPLE.com/en/x?q#f", "x://example.com/en", "s://notexample.com/en/", "h://b.net/fr/1", "h://b.net/frx", "h://com/", "h://É.com/", "h://a.com?x://b.net/es/", "h://..com//", "h://example.com:80/en/", "h://example.com/en/", "h://example.com/en/"]


def test_urls_against_plain_python(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, keys string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: plain_verdict(u, url_filter.RULES) for i, u in enumerate(URLS)}


def test_long_lists_in_one_or_several_parts(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(300)]
    rules = [(rng.choice(["allow", "block"]), h + rng.choice(["/", "/en/", "/a"])) for h in hosts]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(['/', '/en/1', '/ab', ''])}" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.parts_of(rules, 3000, 200) > 2
    for limit in (url_filter.MAX_FILTER_BYTES, 200):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, max_bytes=limit).collect()}
        assert got == want


def test_urls_that_are_long_or_repeated_or_without_id(spark):
    long = "h://b.net/fr/" + "x" * 200_000
    rows = [(None, long), (None, "h://a.com/"), (1, long), (1, long), (2, "h://" + "a." * 5000 + "example.com/en/")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict, len(r.path)) for r in got) == [(0, "com/", "allow", 1), (0, "net/fr/", "block", 200_004), *[(1, "net/fr/", "block", 200_004)] * 2, (2, "example.com/en/", "block", 4)]


def test_cascade_is_exact_with_several_levels(spark):
    universe = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("key % 3 = 0")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 2
    assert universe.filter(url_filter.member(F.col("key"), levels) != (F.col("key") % 3 == 0)).count() == 0


def test_empty_tables(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == mixing.in_the_mix(empty).count() == licenses.scan(empty).count() == 0
    with pytest.raises(ValueError, match="host/path"):
        url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), [("allow", "com")])


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 97 == 0 else "w " * rng.randrange(60), "en", rng.choice(["big"] * 6 + ["a", "b", None, "Z", "é"]), 0) for i in range(900)]
    rows += [(5000, "one two three", "en", "big", 0)] * 3 + [(None, "x y", "en", "a", 0), (6000, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = mixing.mix(df, rows_per_range=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), rows_per_range=64).collect()))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == sizes[s] for r in mine)
        assert sum(r.taken for r in mine) == int(targets[s] + 1e-9)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    kept = mixing.in_the_mix(df, rows_per_range=64)
    assert kept.columns == [*df.columns, "size", "source_size", "target", "taken"]
    assert sorted(r.taken for r in kept.collect()) == sorted(r.taken for r in got if r.taken)


def test_mix_of_documents_without_ids_and_of_very_long_ones(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(None, f"{k} " + "w " * rng.randrange(50), "en", rng.choice("ab"), 0) for k in range(400)] + [(None, "same", "en", "a", 0)] * 9 + [(1, "long " * 400_000, "en", "c", 0)]
    df = spark.createDataFrame(rows, DOCS)
    whole = mixing.in_the_mix(df, rows_per_range=32)
    assert sorted(r.taken for r in whole.collect()) == sorted(r.taken for r in mixing.mix(df, rows_per_range=32).collect() if r.taken)
    # sources too many to broadcast are joined by a shuffle
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.in_the_mix(df, rows_per_range=32).collect())) == sorted(map(str, whole.collect()))


def test_mix_of_many_equal_rows(spark):
    """The budget of ``a`` ends inside a run of equal rows without ids; the other one of them is taken whole."""
    equal = spark.range(30_000).selectExpr("cast(null as bigint) doc_id", "'same text here' text", "'en' lang", "'a' source", "id n_chars")
    other = spark.range(90_000).selectExpr("cast(null as bigint) doc_id", "'b words' text", "'en' lang", "'b' source", "id n_chars")
    df = equal.unionByName(other)
    of_each = mixing.mix(df).groupBy("source", "taken").count().filter("taken > 0")
    kept = mixing.in_the_mix(df)
    assert sorted(map(tuple, kept.groupBy("source", "taken").count().collect())) == sorted(map(tuple, of_each.collect()))
    assert kept.count() == kept.distinct().count()
    weights = mixing.in_the_mix(df, weights=(1.0, 4.0), share=0.3)
    assert {(r.source, r.taken): r["count"] for r in weights.groupBy("source", "taken").count().collect()} == {("a", 3): 5400, ("b", 2): 32400}
    ends = mixing.in_the_mix(df, weights=(1.0, 4.0), share=81005.5 / 270_000)
    assert {(r.source, r.taken): r["count"] for r in ends.groupBy("source", "taken").count().collect()} == {("a", 3): 5400, ("a", 1): 1, ("b", 2): 32402}


def test_mix_carries_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", "old", 7), (2, "c", "s", "old", 8)], "doc_id bigint, text string, source string, taken string, __size bigint")
    out = mixing.in_the_mix(df)
    assert out.columns == ["doc_id", "text", "source", "__size", "size", "source_size", "target", "taken"]
    assert out.agg(F.sum("taken")).head()[0] == 4


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def plain_units(text):
    text = re.sub(r"[.!?]+[\"')]*([ \t\n\r\f])", "\x01\\1", (text or "").lower())
    text = re.sub(r" ?([\n\x01])[ \x01]*", r"\1", re.sub(r"[^\w\n\x01]+|_+", " ", text))
    blocks = re.split("\n\n+", text)
    sentences = [x for p in blocks for x in p.split("\x01")]
    words = [re.split("[ \n\x01]+", x.strip(" \n\x01")) for x in [*text.split("\n"), *sentences, *blocks, text]]
    ends = [w[-n:] for x in sentences if "licens" in x for w in [re.split("[ \n]+", x.strip(" \n"))] for n in licenses.notice_lengths(licenses.TEMPLATES) if len(w) > n]
    spoken = [re.split("[ \n]+", x.strip(" \n")) for x in sentences if "licens" in x]
    starts, lengths = licenses.notice_starts(licenses.TEMPLATES), licenses.notice_lengths(licenses.TEMPLATES)
    inside = [w[i : i + n] for w in spoken for i in range(len(w) - 1) if " ".join(w[i : i + 2]) in starts for n in lengths if len(w) >= i + n]
    return {tuple(w) for w in words + ends + inside}


def test_licenses_against_plain_python(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    texts = [None, "", "x", "Released under the MIT License.", "Prose before.\nLicensed under CC BY-NC 4.0!\nand after", mit.replace(", ", ",\n"), "a\n\n" + mit[:-40] + "\n\nb", "word " * 5000, ("released under the mit license. " * 3000), "the MIT license is not this"]
    texts += ["This is our project, and all of it is released under the MIT License. Please read on.", "Text of ours. (Licensed under the Apache License, Version 2.0.) More text.", "It is\nlicensed under\nCC BY-SA 4.0. Bye", "Dots. . .\n\n. Released under the\nBSD 2-Clause License! ! x.\n. y"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[3], 1)], "doc_id bigint, text string, license int")
    rows = licenses.scan(df).collect()
    got = {r.doc_id: (r.license, r.dice, r.n_matches, r.runner_up) for r in rows}
    want = {}
    templates = [(name, set(b)) for name, ts in licenses.TEMPLATES.items() for b in map(licenses.template_bigrams, ts)]
    for i, t in enumerate(texts):
        found = []
        for w in plain_units(t):
            g = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            found += [(-len(g & b), -dice(g, b), name) for name, b in templates if g and dice(g, b) >= 0.8]
        top = min(found, default=None)
        other = min((f for f in found if f[2] != top[2]), default=(0, 0, None)) if top else None
        want[i] = (top[2], -top[1], len(found), other[2]) if found else (None, None, 0, None)
    want[None] = want[3]
    assert got == want
    assert len(rows) == len(texts) + 2
    assert [got[i][0] for i in (3, 5, 6, 8, 10)] == ["MIT"] * 5
    assert (got[11][0], got[12][0]) == ("Apache-2.0", "CC-BY-SA-4.0")


NAMED = {
    "It was released under the MIT License and maintained by us.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
    "# SPDX-License-Identifier: LGPL-2.1-or-later\nimport os": "LGPL-2.1-or-later",
    "The head says SPDX-License-Identifier: Apache-2.0 and the rest follows below without any further word of it.": "Apache-2.0",
    "This project is under the Apache 2.0 license.": "Apache-2.0",
    "Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)": "CC-BY-SA-4.0",
    "All pages are available under CC BY-NC 4.0 as a license for readers who want to share them with others for free.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Our code is licensed under the GNU General Public License v2.0 since the very first day that we wrote it.": "GPL-2.0",
    "This work is licensed under the GNU General Public License.": "GPL",
    "Our code is licensed under the GNU Lesser General Public License, which you will find in the folder beside it.": "LGPL",
    "Our code is released under the terms that follow, and a license is granted to whoever asks us nicely.": None,
    "You need a driving licence, or a license to fish, under the law of the land.": None,
    "The fee is under the limit, and the license costs 2.0 pounds.": None,
    "She released them under the bridge, without a license.": None,
}


def test_notices_inside_sentences_and_tags(spark):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id bigint, text string")
    assert {r.doc_id: r.license for r in licenses.scan(df).collect()} == dict(enumerate(NAMED.values()))


def test_each_tag_names_its_licence(spark):
    names = [n for n, ts in licenses.TEMPLATES.items() if f"SPDX-License-Identifier: {n}" in ts]
    df = spark.createDataFrame([(i, f"/* SPDX-License-Identifier: {n} */") for i, n in enumerate(names)], "doc_id bigint, text string")
    assert {r.doc_id: r.license for r in licenses.scan(df).collect()} == dict(enumerate(names))


def test_no_licence_is_lost_by_looking_at_rare_bigrams_only(spark):
    """All subsets of a notice's bigrams that reach it meet one of those that are looked at."""
    low = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    sets = [licenses.template_bigrams(t) for ts in licenses.TEMPLATES.values() for t in ts]
    index = licenses.rarest(sets, low)
    for i, g in enumerate(sets):
        first = [x for x in g if i in index.get(x, ())]
        assert len(g) - len(first) < max(1, low * len(g) - 1e-9)


def test_a_list_of_few_templates(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, licenses.MIT_GRANT), (3, None)], "doc_id bigint, text string")
    for templates in ({"MIT": licenses.TEMPLATES["MIT"][:1]}, {"MIT": licenses.TEMPLATES["MIT"][1:2]}):
        got = {r.doc_id: r.license for r in licenses.scan(df, templates).collect()}
        assert got == {1: "MIT" if len(templates["MIT"][0]) < 50 else None, 2: "MIT" if len(templates["MIT"][0]) > 50 else None, 3: None}


def test_licences_that_resemble_each_other(spark):
    gnu = "This program is free software{0} you can redistribute it and/or modify it\nunder the terms of the GNU {1}General Public License as published by\nthe Free Software Foundation{2} either version {3} of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    one = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    two = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    three = "Neither the name of Some Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    end = licenses.BSD_END
    texts = {
        "GPL-2.0-or-later": gnu.format(";", "", ";", 2),
        "GPL-3.0-or-later": gnu.format(":", "", ",", 3),
        "AGPL-3.0-or-later": gnu.format(":", "Affero ", ",", 3),
        "LGPL-3.0-or-later": gnu.format(":", "Lesser ", ",", 3),
        "LGPL-2.1-or-later": gnu.format(";", "Lesser ", ";", "2.1").replace("program", "library"),
        "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
        "BSD-2-Clause": f"Copyright (c) 2020, A. Person\n\n{bsd}\n\n1. {one}\n\n2. {two}\n\n{end}",
        "BSD-3-Clause": f"Copyright (c) 2020, A. Person\n\n{bsd}\n\n1. {one}\n\n2. {two}\n\n3. {three}\n\n{end}",
    }
    bodies = {name: "\n\n".join(licenses.whole(name).split("\n\n")[3:-5]) for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0")}
    rows = [*texts.items(), *bodies.items()]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}
