"""Near-duplicates, repeated strings and decontamination against brute force; edge cases."""

import hashlib
import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import components, decontaminate, near_dup, suffix_dedup
from swarmframe.llm.common import table

SCHEMA = "doc_id bigint, text string, n_chars bigint, class_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], SCHEMA)


# components


def plain_roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "path": [(i, i + 1) for i in range(70)], "star": [(50, i) for i in range(100)], "empty": []}[kind]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == plain_roots({n for e in edges for n in e}, edges)


# near-duplicates


def shingles(text):
    w = text.split()
    out, n = set(), {}
    for i in range(max(len(w) - 4, 1)) if w else ():
        s = tuple(w[i : i + 5])
        n[s] = n.get(s, 0) + 1
        out.add((s, n[s]))
    return out


def plain_classes(rows):
    sets = [shingles(t or "") for _, t in rows]
    ids = [i for i, _ in rows]
    links = [(ids[i], ids[j]) for i, j in itertools.combinations(range(len(rows)), 2) if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    return plain_roots(set(ids), links)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * 4
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """Copies, near copies at all distances, shared passages, short texts, nothing at all."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (5, 30, 120, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(30):
            rows.append((n, edited(rng, base, k % (2 + size // 12))))
            n += 1
    rows += [(n + i, " ".join(rng.choice(vocabulary) for _ in range(80)) + " a passage that very many of these texts share in full") for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "one two"), (906, rows[0][1]), (907, rows[0][1]), (907, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [2048, 25])
def test_classes_against_brute_force(spark, family, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", block)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, family).repartition(5)).collect()}
    assert got == plain_classes(family)


def test_classes_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: near_dup.regions(t) for i, t in rows}
    at = {}
    for i, s in sets.items():
        for g in s.tolist():
            at.setdefault(g, []).append(i)
    pairs = {p for x in at.values() if len(x) < 300 for p in itertools.combinations(sorted(x), 2)}
    links = [p for p in pairs if near_dup.similar(sets[p[0]], sets[p[1]])]
    got = {r.doc_id: r.class_id for r in near_dup.op8_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_roots(set(sets), links)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        a = rng.integers(1, 2**63, 2000).astype(np.uint64)
        b = np.concatenate([a[: int(2000 * share)], rng.integers(1, 2**63, 2000 - int(2000 * share)).astype(np.uint64)])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = np.mean(near_dup.dart_signature(np.sort(a), 4000) == near_dup.dart_signature(np.sort(b), 4000))
        assert abs(got - exact) < 0.04


def test_repeats_weigh():
    assert len(near_dup.regions("a b c d e " * 20)) == 96
    assert len(near_dup.regions("a b")) == 1
    assert len(near_dup.regions("")) == 0
    assert not near_dup.similar(near_dup.regions("a b c d e " * 20), near_dup.regions("a b c d e " * 10))


def test_one_of_each_and_edge_cases(spark, family):
    docs = frame(spark, family)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    want = plain_classes(family)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()})
    assert near_dup.near_duplicates(docs.limit(0)).count() == near_dup.one_of_each(docs.limit(0)).count() == 0
    odd = near_dup.near_duplicates(frame(spark, [(None, "same text here"), (4, "same text here"), (4, "other"), (9, "other")])).collect()
    assert {r.class_id for r in odd} == {4}


def test_documents_without_ids_are_not_one_document(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(40)) for _ in range(6)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (7, texts[1]), (None, None), (None, "")]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted((i or 0, 7 if t == texts[1] else 0) for i, t in rows)
    kept = near_dup.one_of_each(frame(spark, rows)).collect()
    assert sorted(r.text or "" for r in kept) == sorted(["", *texts])
    with pytest.raises(TypeError, match="integer id"):
        near_dup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_large_groups_are_compared_exactly(spark, monkeypatch):
    """A chain of near copies of one text, each 0.8 similar to its neighbours only, among texts that share half of it."""
    monkeypatch.setattr(near_dup, "STAR", 7)
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(104)]
    rows = [(i, " ".join(base[:52] + [f"x{i}.{k}" for k in range(52)])) for i in range(60)]
    for k in range(70):
        rows.append((100 + k, " ".join(base)))
        base[(7 * k) % 104] = f"y{k}"
    for block in (256, 16):
        monkeypatch.setattr(near_dup, "BLOCK_TEXTS", block)
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
        assert got == plain_classes(rows)


def test_no_similar_pair_is_missed_inside_a_block():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(1, 2**40, rng.integers(5, 60)).astype(np.uint64)
        units = [np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(1, 2**40, len(base)).astype(np.uint64), base)) for _ in range(70)]
        met = {p for g in near_dup.meeting(units) for p in itertools.combinations(g.tolist(), 2)}
        assert {(i, j) for i, j in itertools.combinations(range(70), 2) if near_dup.similar(units[i], units[j])} <= met


# repeated strings


def plain_cut(rows):
    """Per row in order of (doc_id, hash of the text): what is left."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16)))


def texts_with_repeats():
    rng = random.Random(3)
    base = "".join(rng.choice("abé") for _ in range(2500))
    piece = lambda n: base[(a := rng.randrange(2000)) : a + rng.randrange(n)]
    rows = [(i, piece(500) + rng.choice(["", "x", "é" * 60]) + piece(300)) for i in range(120)]
    rows += [(300 + i, "a" * rng.randrange(400)) for i in range(12)] + [(400, ""), (401, "é" * 2000), (402, None), (403, base), (404, base), (None, base)]
    return [*rows, (405, "short"), (406, "short"), (3, base[:900]), (403, base), (407, "\0" * 300), (408, "ab" * 90 + "\0" * 150)]


@pytest.mark.parametrize("sizes", [suffix_dedup.Sizes(), suffix_dedup.Sizes(1 << 10, 1 << 12, 40), suffix_dedup.Sizes(64, 1 << 12, 40, 3), suffix_dedup.Sizes(1 << 12, 1 << 14, 40, 1)])
def test_cut_against_brute_force(spark, sizes, monkeypatch):
    """Also in small blocks, with texts over several blocks, with many levels, with most or all hashes taken for hot."""
    if sizes.often < 1000:
        monkeypatch.setattr(suffix_dedup, "HOT", 0)  # the driver decides which hashes are hot
    rows = texts_with_repeats()
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(6), sizes=sizes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_cut(in_order(rows))))


@pytest.mark.parametrize("partitions", [3, 64])
def test_cut_in_many_small_groups_and_buckets(spark, partitions, monkeypatch):
    """As many as the bytes call for, whatever the shuffle partitions; documents without ids and very short ones in any group."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rows = [(None if i is not None and i % 3 else i, t) for i, t in texts_with_repeats()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(6), sizes=suffix_dedup.Sizes(1 << 12, 1 << 14, 40)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_cut(in_order(rows))))
    with pytest.raises(TypeError, match="integer id"):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_window_hashes_tell_bytes_apart():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    at = np.arange(len(data) - suffix_dedup.LENGTH + 1)
    for h in suffix_dedup.window_hashes(data, at):
        assert len(np.unique(h)) == len({data[a : a + suffix_dedup.LENGTH].tobytes() for a in at})
    for place in range(suffix_dedup.LENGTH):
        other = data.copy()
        other[place] ^= 1
        assert (suffix_dedup.window_hashes(other, at[:1]) != suffix_dedup.window_hashes(data, at[:1])).all()


def test_family_has_few_levels():
    rng = np.random.default_rng(5)
    family = suffix_dedup.Family()
    for _ in range(37):
        size = np.full(8, suffix_dedup.LENGTH + 20)
        body = rng.integers(0, 255, int(size.sum())).astype(np.uint8)
        meta = np.stack([*[np.zeros(8, np.int64)] * 3, np.arange(8), np.full(8, 20), np.zeros(8, np.int64), size], axis=1)
        assert not family.add(suffix_dedup.surroundings(meta, body, np.cumsum(size))).any()
    assert [len(x) for x in family.levels] == [8 * 32, 8 * 4, 8]
    for level in family.levels:
        for rows, order in zip((level.right, level.left), level.orders, strict=True):
            assert (rows[order][1:] >= rows[order][:-1]).all()


def test_texts_are_rewritten(spark):
    rows = in_order(texts_with_repeats())
    docs = frame(spark, rows)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert out.count() == len(rows)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_documents_cut(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert sorted(map(tuple, suffix_dedup.op9_suffix_dedup(spark, sf).collect())) == plain_cut(rows)


# decontamination


def distances(item, text, size):
    """Least edits between each window of an item and any stretch of a text, by the whole table."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(item, np.uint8), size)
    letters, j = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    cost = np.zeros((len(rows), len(text) + 1), int)
    for i in range(size):
        new = cost + 1
        new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + (letters != rows[:, i, None]))
        cost = np.minimum.accumulate(new - j, axis=1) + j
    return cost.min(1)


def plain_found(texts, items):
    out = {}
    for k, t in enumerate(texts):
        for number, item in items:
            item, n = decontaminate.normalise(item), decontaminate.normalise(t)
            if len(item) >= decontaminate.MIN_ITEM:
                size = min(len(item), decontaminate.WINDOW)
                e = distances(item, n, size)
                hit = np.flatnonzero(e <= size // 10)
                if len(hit):
                    out[k, number] = (int(hit[0]), int(e[hit[0]]))
    return out


def found(texts, items, **options):
    return {(a, b): (s, e) for a, b, s, e in decontaminate.found_in(texts, decontaminate.blocks_of(items, **options))}


@pytest.fixture(scope="module")
def items(spark, sf):
    return sorted((r.item_id, r.text) for r in table(spark, sf, "benchmark").collect())[:12] + [(500, "too short"), (501, "A sentence of under fifty bytes.")]


def mutated(rng, text, n):
    text = list(text)
    for _ in range(n):
        p = rng.randrange(len(text))
        text[p : p + 1] = rng.choice(["", "q", text[p] + "z"])
    return "".join(text)


def test_found_equals_alignment(items, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "nothing of the kind", "  a SENTENCE,of under fifty (bytes)! "]
    for k in range(36):
        t = rng.choice(items[:12])[1]
        a = rng.randrange(60)
        texts.append(rng.choice(["", "before it. "]) + mutated(rng, t[a : a + 50 + rng.randrange(90)], k % 13) + rng.choice(["", " and after."]))
    got = found(texts, items)
    assert got == plain_found(texts, items)
    assert len(got) > 8
    # the same in many indexes, in pieces, and in slices of a few shared grams
    monkeypatch.setattr(decontaminate, "PIECE", 128)
    monkeypatch.setattr(decontaminate, "HITS", 500)
    monkeypatch.setattr(decontaminate, "CHUNK", 700)
    assert found(texts, items, block_bytes=300) == got


def test_quotes_begin_anywhere():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    item = " ".join(word() for _ in range(60))[:240].strip()
    blocks = decontaminate.blocks_of([(7, item)])
    quotes = [(a, item[a : a + 96]) for a in range(len(item) - 95) if item[a] != " " != item[a + 95]]
    around = lambda q: f"{' '.join(word() for _ in range(9))} {q} {' '.join(word() for _ in range(9))}"
    texts = [around(q) for _, q in quotes] + [around(q[:30] + "q" + q[31:60] + "q" + q[60:]) for _, q in quotes]
    # as many edits as are allowed, evenly spread
    texts += [around("".join("0" if k % 10 == 5 and k < 90 else c for k, c in enumerate(q))) for _, q in quotes]
    assert {x[0] for x in decontaminate.found_in(texts, blocks)} == set(range(len(texts)))
    assert not decontaminate.found_in([around("")] * 3, blocks)


def test_short_items_with_as_many_edits_as_allowed():
    for size in range(24, 97):
        item = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(size))
        blocks = decontaminate.blocks_of([(1, item)])
        edits = size // 10
        # edits spread evenly, so that no piece between them is longer than it must be
        cut = [(k + 1) * (size + 1) // (edits + 1) - 1 for k in range(edits)]
        text = "".join("0" if i in cut else c for i, c in enumerate(item))
        assert [x[3] for x in decontaminate.found_in([text, "x " + text + " y"], blocks)] == [edits] * 2
    assert not decontaminate.blocks_of([(1, "a b c d e f g h i j k l")])


def test_repetitive_texts_in_bounded_memory():
    code = """
import resource
from swarmframe.llm import decontaminate as d
blocks = d.blocks_of([(1, "a" * 500), (2, "ab " * 2000), (3, "prose before it " + "b" * 200)])
got = d.found_in(["a" * 2_000_000, "ab " * 100_000, "b" * 100_000], blocks)
assert [(t, i) for t, i, *_ in got] == [(0, 1), (1, 2), (2, 3)], got
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 900_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=Path(__file__).parents[2])


def test_every_planted_item_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: decontaminate.normalise(r.text) for r in table(spark, sf, "documents").collect()}
    marks = {r.item_id: decontaminate.normalise(r.text) for r in table(spark, sf, "benchmark").collect()}
    exact = {(d, i) for d, t in docs.items() for i, m in marks.items() if m in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op1_decontamination(spark, sf).collect()}
    assert exact
    assert exact == got


def test_item_of_several_texts_in_several_passes(spark, items):
    several = [(k % 3, t) for k, (_, t) in enumerate(items[:12])]
    bench = spark.createDataFrame(several, "item_id bigint, text string")
    docs = frame(spark, [(1, " ".join(t for _, t in items[:12])), (1, items[0][1] + " and " + items[3][1])])
    whole = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    assert len(whole) == 4
    for size in (100, 700, 1500):
        assert whole == sorted(map(str, decontaminate.contaminated(docs, bench, pass_bytes=size).collect()))
    with pytest.raises(TypeError):
        decontaminate.contaminated(docs, bench.withColumn("item_id", F.lit("a")))


def test_blocks_and_edge_cases(spark, items):
    bench = spark.createDataFrame([*items, (None, "x" * 90), (600, None)], "item_id bigint, text string")
    docs = frame(spark, [(1, "see: " + items[0][1].upper()), (1, "see: " + items[0][1].upper()), (2, None), (3, "clean " * 50), (None, items[3][1] + "\n" + items[4][1])])
    whole = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    assert len(whole) == 4
    assert whole == sorted(map(str, decontaminate.contaminated(docs, bench, block_bytes=300).collect()))
    assert whole == sorted(map(str, decontaminate.contaminated(docs, bench, pass_bytes=1500).collect()))
    assert [r.item_id for r in decontaminate.short_items(bench).collect()] == [500]
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=300)
    assert (kept.columns, sorted(r.doc_id for r in kept.collect())) == (docs.columns, [2, 3])
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.contaminated(a, b).count() == 0
        assert decontaminate.drop_contaminated(a, b).count() == a.count()
