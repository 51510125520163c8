"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from swarmframe.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def plain(docs, target, percent=25, min_words=20):
    both = [plain_features(t) for _, t in docs]
    s, t = (Counter(b for _, f in x for b in f) for x in (both, [plain_features(x) for x in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (n, f) in zip(docs, both):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    return rows, drawn


TEXTS = ["", None, "one", "Ä Öl ÄRGER", "a,b;c--d", "1 2 3 1 2 3", " ", "x" * 200 + " y " + "z" * 70 + " " + "z" * 70, "\U0001f600é A\x00b", "A B\nc\td"]


@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_buckets(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(2)
    for text in TEXTS + ["".join(rng.choice("abAB 12,é\n") for _ in range(rng.randrange(300))) for _ in range(200)]:
        n, found = importance.text_buckets(text)
        words, expected = plain_features(text)
        assert n == words and Counter(found.tolist()) == Counter(expected), text


def test_run_lengths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4000):
        s = rng.integers(0, 50, n).astype(np.uint16)
        b, c = importance.run_lengths(s)
        assert dict(zip(b.tolist(), c.tolist())) == Counter(s.tolist())


@pytest.mark.parametrize("stream", [16, 1 << 20])
def test_resampled(spark, monkeypatch, stream):
    monkeypatch.setattr(importance, "STREAM", stream)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(80)]
    docs = [(i * 3 - 40, " ".join(rng.choice(words[: rng.choice([20, 80])]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(docs[9][0], docs[9][1])] * 2 + [(None, docs[8][1])] * 30
    target = [" ".join(rng.choice(words[:20]) for _ in range(30)) for _ in range(8)] + [None]
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in docs], "doc_id bigint, text string, score string, rank int").repartition(5)
    rows, drawn = plain(docs, target)
    got = importance.resampled(frame, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(r[:4]) for r in rows)
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resampled(none, target).collect() == []
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    rows, drawn = plain([(1, "a " * 30)], [])
    (r,) = importance.resampled(one, target).collect()
    assert [r.doc_id, r.n_features, r.weight, r.score] == rows[0][:4] and r.rank is None and not drawn
    with pytest.raises(TypeError):
        importance.resampled(spark.createDataFrame([("a", "b")], "doc_id string, text string"), target)
