"""Quality rules and the quality classifier: counts against plain code, verdicts on labelled rows, edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swarmframe.llm import quality_model, quality_rules, text_stats
from swarmframe.llm.common import table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text("ab \n\t\x0b\x1c\u00a0é#*$<日", max_size=60), st.lists(st.sampled_from(["a", "b", "c", "\n"]), max_size=40).map(" ".join)))
def test_counts(text):
    assert text_stats.text_stats(text)[0] == plain_counts(text)


def test_distinct_words_of_the_whole_text():
    at = text_stats.RATIOS.index("distinct")
    share = lambda words: text_stats.text_stats(" ".join(words))[1][at]
    varied, poor = [f"w{i}" for i in range(200)], ["a", "b"] * 100
    assert share(varied) == 1 and share(poor) == 0.01
    assert share(varied + poor * 3) == share(poor * 3 + varied) == pytest.approx((200 + 3 * 2) / 800)
    assert share(varied + poor[:50]) == pytest.approx(202 / 250)
    assert share(varied * 40) == 1 and share(varied[:7] + ["w0"]) == 7 / 8 and share([]) == 0


@pytest.fixture(scope="module")
def labelled(spark):
    return "/root/testdata/sf0.01"


def test_rules_on_labelled_rows(spark, labelled):
    out = quality_rules.op2_quality_rules(spark, labelled)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = out.join(table(spark, labelled, "labels"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((0, True), 0) <= 1
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    docs = {r.doc_id: r.text for r in table(spark, labelled, "documents").collect()}
    for r in out.collect():
        counts = plain_counts(docs[r.doc_id])
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)


def test_forest_isolates_what_lies_outside():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, (500, 4))
    forest = quality_rules.grow_forest(x)
    out = np.array([[0, 0, 0, 3.0], [0.0] * 4, [3, 3, 3, 3]])
    far, near, further = forest.score(out)
    assert near < far < further
    again = quality_rules.grow_forest(x)
    assert (again.score(out) == forest.score(out)).all()


EDGE = [(1, None), (2, ""), (3, "word " * 60), (3, "word " * 60), (4, "ok fine " * 3), (5, "\n\t  ")]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id bigint, text string, kept string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.learn(docs, none)
    assert rules.forest is None
    rows = quality_rules.judge(docs, rules).collect()
    assert len(rows) == len(EDGE)
    assert all(r.base_failed and not r.kept for r in rows)
    assert quality_rules.keep_good(docs, rules).columns == docs.columns
    assert quality_rules.judge(docs.limit(0), rules).count() == 0
    scores = quality_model.classify(docs, none).collect()
    assert {r.score for r in scores} == {0.5}
    assert quality_model.classify(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality_model.classify(docs, odd).collect()} == {0.5}


def test_sample_is_bounded_and_consistent(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(0, 1), (None, 1), (60, None)], "doc_id bigint, quality int")
    got = quality_rules.labelled_sample(labels, limit=10).collect()
    assert len(got) == 10
    assert all(r.doc_id != 0 and r.good == bool(r.doc_id % 2) for r in got)
    assert quality_rules.labelled_sample(labels).count() == 49


def test_classifier_on_held_out_rows(spark, labelled):
    out = quality_model.op4_quality_classifier(spark, labelled)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(table(spark, labelled, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert out.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0


def test_held_out_labels_do_not_matter(spark, labelled):
    docs, labels = table(spark, labelled, "documents").limit(300), table(spark, labelled, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_model.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_isotonic():
    y = quality_model.isotonic(np.array([0.1, 0.5, 0.3, 0.9, 0.2]), np.array([1.0, 1, 3, 1, 1]))
    assert (np.diff(y) >= 0).all()
    assert y == pytest.approx([0.1, 0.35, 0.35, 0.55, 0.55])


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (40, 5))
    phi = quality_model.Cosines.draw(np.zeros(5), np.ones(5), 8192)(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / quality_model.WIDTH**2)
    assert np.abs(phi @ phi.T - exact).max() < 0.06


def plain_path(forest, row, at, depth=0):
    """Edges from a node to a leaf, and what the leaf's size adds, one row at a time."""
    if forest.feature[at] < 0:
        return float(forest.depth[at])
    child = forest.child[at] + (1 if row[forest.feature[at]] > forest.cut[at] else 0)
    return plain_path(forest, row, child, depth + 1)


def plain_tree(x, rng, margin, depth=0):
    """An isolation tree grown by recursion on its own draws: (feature, cut, left, right) or a leaf's path length."""
    if depth >= quality_rules.MAX_DEPTH or len(x) < 2:
        return depth + float(quality_rules.average_path(len(x)))
    f = int(rng.integers(x.shape[1]))
    cut = rng.uniform(x[:, f].min() - margin, x[:, f].max() + margin)
    left = x[:, f] <= cut
    return f, cut, plain_tree(x[left], rng, margin, depth + 1), plain_tree(x[~left], rng, margin, depth + 1)


def plain_depth(tree, row):
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def test_forest_scores_against_recursion():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (400, 5))
    forest = quality_rules.grow_forest(x, trees=60)
    rows = np.concatenate([x[:30], rng.normal(0, 2, (60, 5))])
    expected = 2 * (np.log(forest.sample - 1) + np.euler_gamma) - 2 * (forest.sample - 1) / forest.sample
    plain = [2 ** (-np.mean([plain_path(forest, r, root) for root in forest.roots]) / expected) for r in rows]
    assert forest.score(rows) == pytest.approx(plain)
    # trees grown apart, with other draws, order the rows alike
    trees = [plain_tree(x[rng.choice(len(x), forest.sample, replace=False)], rng, quality_rules.MARGIN) for _ in range(600)]
    other = [2 ** (-np.mean([plain_depth(t, r) for t in trees]) / expected) for r in rows]
    assert np.corrcoef(forest.score(rows), other)[0, 1] > 0.95


def test_threshold_against_all_cuts():
    rng = np.random.default_rng(6)
    counts = np.full((900, len(text_stats.COUNTS)), 100)
    counts[:, 4] = 0
    good = rng.random(900) < 0.7
    ratios = np.abs(rng.normal(0.3, 0.05, (900, len(text_stats.RATIOS)))) + (~good & (rng.random(900) < 0.8))[:, None] * 0.4
    rules = quality_rules.fit(counts, ratios, good, max_good_lost=0.01)
    s = rules.anomaly(ratios)
    cost = lambda c: (np.mean(s[good] > c) if np.mean(s[good] > c) <= 0.01 else np.inf) + np.mean(s[~good] <= c)
    assert cost(rules.threshold) == pytest.approx(min(cost(c) for c in s))


def test_verdicts_do_not_depend_on_partitions(spark, labelled):
    docs, labels = table(spark, labelled, "documents"), table(spark, labelled, "labels")
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1))
    a, b = (quality_rules.learn(twice.repartition(n), labels) for n in (3, 7))
    assert a.threshold == b.threshold and (a.low == b.low).all() and (a.high == b.high).all()
    as_text = quality_rules.learn(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert as_text.forest is not None


def plain_isotonic(y, w):
    """Largest mean of what ends here of the least means of what begins earlier."""
    mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


def test_scores_against_a_dense_fit(spark, labelled):
    """The same statistics on one machine: least squares over stacked rows, plain isotonic means, interpolation."""
    docs, labels = table(spark, labelled, "documents").limit(700).toPandas(), table(spark, labelled, "labels").toPandas()
    known = labels.dropna(subset=["quality"]).groupby("doc_id").quality.agg(["min", "max"])
    known = known[known["min"] == known["max"]]["min"]
    x = quality_model.inputs(*text_stats.batch_stats(docs.text.tolist()))
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in docs.doc_id])
    y = docs.doc_id.map(known).to_numpy(float)
    fit, held = ~np.isnan(y) & (part < 2), ~np.isnan(y) & (part == 3)
    mean, scale = x[fit].mean(0), x[fit].std(0)
    cosines = quality_model.Cosines.draw(mean, scale)
    phi = cosines(x)
    ridge = np.sqrt([quality_model.RIDGE * fit.sum()] * quality_model.FEATURES + [1e-9 * fit.sum()])
    beta = np.linalg.lstsq(np.concatenate([phi[fit], np.diag(ridge)]), np.concatenate([y[fit], np.zeros(len(ridge))]), rcond=None)[0]
    raw, bins = phi @ beta, quality_model.BINS
    at = np.clip(((raw[held] + 0.5) / 2 * bins).astype(int), 0, bins - 1)
    used = np.unique(at)
    n = np.array([(at == b).sum() for b in used])
    share = np.array([(y[held][at == b].sum() + 0.5 * y[fit].mean()) / ((at == b).sum() + 0.5) for b in used])
    want = np.clip(np.interp(raw, (used + 0.5) / bins * 2 - 0.5, plain_isotonic(share, n)), 0, 1)
    got = quality_model.classify(spark.createDataFrame(docs[["doc_id", "text"]]), table(spark, labelled, "labels")).toPandas().set_index("doc_id").score
    assert got.loc[docs.doc_id].to_numpy() == pytest.approx(want, abs=1e-6)


def test_very_long_texts_and_ties(spark, labelled):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 300_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, None)], "doc_id bigint, text string")
    labels = table(spark, labelled, "labels")
    rules = quality_rules.learn(table(spark, labelled, "documents"), labels)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    assert rows[1][1:] == rows[2][1:] and rows[1].n_words == 300_000
    scores = {r.doc_id: r.score for r in quality_model.classify(docs.union(table(spark, labelled, "documents").filter("doc_id > 3").select("doc_id", "text")), labels).collect()}
    assert scores[1] == scores[2]


def test_sums_meet_in_levels(spark):
    width = len(quality_model.RATIOS) + 1
    rows = spark.range(500).selectExpr(f"array_repeat(cast(id as double), {width}) x", "cast(id % 2 as double) y").repartition(30)
    for fan_in in (2, 5, 64):
        assert quality_model.summed(rows, lambda x, y: np.array([len(x), y.sum(), x[:, 0].sum()]), fan_in).tolist() == [500, 250, 499 * 250]
