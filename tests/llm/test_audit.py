"""Filter interaction audit against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from swarmframe.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def plain_mask(text):
    n, distinct, capitals, symbols, points = plain_counts(text)
    return (n < 200) + 2 * (100 * distinct < 50 * n) + 4 * (100 * capitals > 2 * points) + 8 * (symbols > 0)


def plain_audit(docs, labels):
    rows = []
    for i, text, source in docs:
        mask = plain_mask(text) + 16 * (i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs))
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", mask, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        here, removed_by = [r[1:] for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(here)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                removed_by[letter] += len(gone)
                failing = sum(bool(r[0] & bit) for r in here)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == bit for r in here), sum(r[1] for r in gone), sum(r[2] for r in gone), letter]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = removed_by[out[key][6]]
    return out


TEXTS = ["", None, "a", " ", "\n\t ", "A B c", "x " * 300, "é ü " * 50, "Aé#b |", "word" * 9, "a b c", " lead and trail ", "\U0001f600 \U0001f600 x", "a\x1cb a\x85c", "one two one two one", "X" * 40 + " y"]


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_counts(monkeypatch, block):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab A\n#é") for _ in range(rng.randrange(400))) for _ in range(200)]
    monkeypatch.setattr(audit, "BLOCK", block)
    for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
        found, digests = audit.counts(array)
        assert found.tolist() == [plain_counts(t) for t in texts]
        assert digests == [hashlib.sha256((t or "").encode()).digest() for t in texts]
        assert audit.masks(found).tolist() == [plain_mask(t) for t in texts]


def test_colliding_hashes(monkeypatch):
    monkeypatch.setattr(audit, "VALUES", np.ones(256, np.uint64))  # words of one length get one hash
    texts = ["ab cd ab ef ab", "a b a", "x", "aa bb " * 300]
    for block in (16, 1 << 20):
        monkeypatch.setattr(audit, "BLOCK", block)
        assert audit.counts(pa.array(texts))[0].tolist() == [plain_counts(t) for t in texts]


def test_audit(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(150)] + ["Big", "LOUD", "a#b", "100%"]
    long = [" ".join(rng.choice(vocabulary[: rng.choice([60, 150, 154])]) for _ in range(rng.randrange(150, 500))) for _ in range(40)]
    docs = [(i, rng.choice([*TEXTS, *long]), rng.choice([None, "", "web", "book"])) for i in range(120)]
    docs += [(5, docs[5][1], "web"), (None, docs[3][1], "web"), (None, docs[3][1], "web"), (None, "only here", "book"), (-4, docs[9][1], "web")]
    labels = [(rng.randrange(120), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(80)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id bigint, text string, source string, n bigint, mask boolean")
    got = audit.interactions(audit.mask_counts(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))).collect()
    expected = plain_audit(docs, labels)
    assert len(got) == len(expected) == 600 * 3
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == expected[r.part, r.filter_order, r.step], r


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.interactions(audit.mask_counts(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    got = audit.interactions(audit.mask_counts(one, labels)).collect()
    assert {r.part for r in got} == {""} and len(got) == 600
    assert {(r.kept, r.removed) for r in got if r.filter_order[r.step - 1] == "A"} == {(0, 1)}
