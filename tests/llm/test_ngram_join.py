"""N-gram Jaccard join against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from swarmframe.llm import ngram_join as join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def plain_components(docs):
    """doc_id, size, least id for rows; rows of one id are one document."""
    sets = [plain_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    at = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            up[find(i)] = find(at.setdefault(d, i))
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def altered(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [w[k], f"more{rng.randrange(999)}"]]) or [w[k]]
    return " ".join(w)


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 12, 20, 60, 150, 400]))) for _ in range(60)]
    texts += [altered(rng, rng.choice(texts), rng.randrange(1, 8)) for _ in range(160)]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts += [altered(rng, base, rng.randrange(1, 6)) for _ in range(80)]  # a crowd, few of which link with the least
    common = " ".join(rng.choice(words) for _ in range(60))
    texts += [common + " " + " ".join(rng.choice(words) for _ in range(n)) for n in (5, 6, 7, 8, 9, 10, 30, 60) for _ in range(5)]
    chain = [f"c{k}" for k in range(260)]
    texts += [" ".join(chain[4 * k : 4 * k + 100]) for k in range(40)]  # each links with the next ones only
    texts += ["", None, " \n", "a", "A", "a b c", "A b C", "a b c d", "a b c d e", "Ä b c d", "ä b c d"]
    return texts


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_sets(monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    texts = corpus(random.Random(1)) + ["\u00e9" * 40 + " b c d e", "x" * 100, "x" * 100 + "\n" + "y" * 100 + " z z"]
    for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
        assert [len(s) for s in join.shingle_sets(array)] == [len(plain_set(t)) for t in texts]
    # a word's hash does not depend on the block that it lies in
    whole = join.shingle_sets(pa.array(texts))
    monkeypatch.setattr(join, "BLOCK", 1 << 20)
    assert all((a == b).all() for a, b in zip(whole, join.shingle_sets(pa.array(texts))))
    long = " ".join(f"v{k % 977} y{k}" for k in range(200_000))
    assert len(join.shingle_sets(pa.array([long, "a b c d"]))[0]) == 400_000 - 3


def test_bounds():
    for a, b in itertools.product(range(1, 60), repeat=2):
        for shared in range(min(a, b) + 1):
            if 100 * shared >= 85 * (a + b - shared):
                assert a + b - 2 * shared <= join.most_apart(a + b)
                low, high = sorted((a, b))
                assert join.stratum(high) <= join.stratum(100 * low // 85)
    for k in range(12):
        blocks, spare = join.dealing(k)
        assert not blocks or blocks - spare == join.most_apart(2 * (join.STRATA[k + 1] - 1)) + 1


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 55, 90, 150, 333, 900]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, n // 6 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, rng.integers(0, n // 6 + 1)).astype(np.uint64)]))
            if join.links(a, b) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(join.cells_of(a), join.cells_of(b))), (len(a), len(b))


def test_dealings_run_out(monkeypatch):
    """Sets with too many empty blocks in every dealing still meet."""
    monkeypatch.setattr(join, "DEALINGS_OF", [(b, 0 if b else 0) for b, _ in join.DEALINGS_OF])
    test_linked_sets_share_a_cell()


def test_tree():
    rng = np.random.default_rng(4)
    sizes = rng.integers(5, 400, 500)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes]
    sets += [s[rng.random(len(s)) < 0.95] for s in sets[:200]]
    counts, sizes = np.stack([join.point(s) for s in sets]), np.array([len(s) for s in sets])
    for n in (1, 2, 16, 17, 300, len(sets)):
        tree = join.CountTree(counts[:n], sizes[:n])
        for i in range(0, len(sets), 7):
            shared = np.minimum(counts[:n], counts[i]).sum(1)
            fits = (185 * shared >= 85 * (sizes[:n] + sizes[i])) & (85 * sizes[:n] <= 100 * sizes[i]) & (85 * sizes[i] <= 100 * sizes[:n])
            assert sorted(tree.search(counts[i], sizes[i]).tolist()) == np.flatnonzero(fits).tolist()


def test_exact_threshold():
    a = np.arange(1, 101, dtype=np.uint64)
    assert join.links(a, np.concatenate([a[:85]])) and not join.links(a, a[:84])
    assert join.links(a[:92], np.arange(9, 101, dtype=np.uint64)) is (100 * 84 >= 85 * 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, monkeypatch, seed):
    if seed == 2:  # small blocks of everything
        for name, value in (("ENTRIES", 300), ("REMEMBERED", 5), ("SCANNED", 3), ("BLOCK", 64), ("STAR", 3), ("PAGE", 4), ("PAGE_SHINGLES", 500), ("FAN", 2)):
            monkeypatch.setattr(join, name, value)
    rng = random.Random(seed)
    docs = list(enumerate(corpus(rng)))
    rng.shuffle(docs)
    docs += [(i, docs[k][1]) for k, i in enumerate(range(5000, 5040))]  # copies
    docs += [(7, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (None, "all by itself here it is"), (None, "")]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id int, text string, size int, node string").repartition(6)
    got = join.linked_components(frame)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(docs)


def test_tree_finds_what_stars_miss(spark):
    """A crowd that shares cells with its least set without linking with it."""
    rng = random.Random(9)
    chain = [f"c{k}" for k in range(700)]
    docs = [(k, " ".join(chain[2 * k : 2 * k + 200])) for k in range(250)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert {r.component_id for r in join.linked_components(frame).collect()} == {0}


def test_empty_and_refused(spark):
    assert join.linked_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(TypeError):
        join.linked_components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
