"""The pipeline's stages against plain versions, each on its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from swarmframe.llm import decontaminate, near_dup, quality_rules, suffix_dedup, text_stats
from swarmframe.llm.common import table
from tests.llm.test_dedup import distances, plain_cut


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_columns_and_ids(stages):
    for k, (before, after) in enumerate(stages):
        assert list(after.columns)[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (len(after.columns) > 5) == (k == 4)
        assert after.doc_id.is_unique
        assert set(after.doc_id) <= set(before.doc_id)


def plain_score(forest, rows):
    """Anomaly of scaled ratios, tree by tree and row by row."""
    expected = 2 * (np.log(forest.sample - 1) + np.euler_gamma) - 2 * (forest.sample - 1) / forest.sample
    out = []
    for row in rows:
        total = 0.0
        for root in forest.roots:
            at = root
            while forest.feature[at] >= 0:
                at = forest.child[at] + (1 if row[forest.feature[at]] > forest.cut[at] else 0)
            total += forest.depth[at]
        out.append(2 ** (-total / len(forest.roots) / expected))
    return np.array(out)


def test_quality_keeps_what_the_rules_keep(spark, sf, stages):
    before, after = stages[0]
    rules = quality_rules.learn(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = set()
    counts, ratios = text_stats.batch_stats(before.text.tolist())
    scaled = quality_rules.spread(ratios, rules.low, rules.high)
    for i, c, a in zip(before.doc_id, counts, plain_score(rules.forest, scaled), strict=True):
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and a <= rules.threshold + 1e-12:
            want.add(i)
    assert set(after.doc_id) == want
    assert after.merge(before, on="doc_id").eval("text_x == text_y").all()
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    good = {i for i, c in zip(before.doc_id, counts, strict=True) if labels.get(i) == 1 and c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert len(good - want) <= 0.02 * len(good)


def test_one_document_of_each_class(stages):
    before, after = stages[1]
    kept = {i: near_dup.regions(t) for i, t in zip(after.doc_id, after.text, strict=True)}
    by = {}
    for i, u in kept.items():
        for g in u.tolist():
            by.setdefault(g, set()).add(i)
    near = lambda u: {i for g in u.tolist() for i in by.get(g, ())}
    for i, u in kept.items():
        assert not any(near_dup.similar(u, kept[j]) for j in near(u) - {i})
    assert len(before) > len(after)


def test_repeats_are_cut(stages):
    before, after = stages[2]
    rows = sorted(zip(before.doc_id, before.text, strict=True))
    sizes = dict(zip(after.doc_id, (len(t.encode()) for t in after.text), strict=True))
    for i, size, gone, _, _ in plain_cut(rows):
        assert size - gone - 6 <= sizes[i] <= size - gone


def test_contaminated_documents_go(spark, sf, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    marks = [decontaminate.normalise(t) for _, t in items]
    exact = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(m in decontaminate.normalise(t) for m in marks)}
    gone = set(before.doc_id) - set(after.doc_id)
    assert exact <= gone
    # what goes beside the exact quotes is near an item by the whole table of edits; of what stays, those that share most with an item are not
    texts = {i: decontaminate.normalise(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    grams = [{m[k : k + 8] for k in range(len(m) - 7)} for m in marks]
    shared = {i: sorted(((sum(n.count(x) > 0 for x in g) / len(g), k) for k, g in enumerate(grams)), reverse=True)[:2] for i, n in texts.items()}
    stay = sorted(set(after.doc_id), key=lambda i: shared[i], reverse=True)[:12]
    for i in [*(gone - exact), *stay]:
        found = any((distances(marks[k], texts[i], min(len(marks[k]), 96)) <= min(len(marks[k]), 96) // 10).any() for _, k in shared[i])
        assert found == (i in gone)


def test_mix(stages):
    before, after = stages[4]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert (after.text.map(words) == after["size"]).all()
    assert ((after.taken > 0) & (after.taken <= 2 * after["size"])).all()
    taken = after.groupby("source").taken.sum()
    target = after.groupby("source").target.first()
    assert (abs(taken - target) <= 1).all()
    assert taken.sum() == pytest.approx(1.5 * before.text.map(words).sum(), abs=25)


def test_registered_and_runs(spark, sf, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() == len(stages[4][1])
    assert suffix_dedup.LENGTH == 100


def test_pipeline_on_odd_tables(spark, sf, tmp_path):
    """Null ids, texts and sources, repeated rows and ids, a very long text, columns with clashing names; then nothing at all."""
    docs = table(spark, sf, "documents")
    good = [r.text for r in docs.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").filter("n_chars > 900").limit(9).collect()]
    words = " ".join(f"{a}{b}" for a in good[7].split()[:300] for b in range(60))
    own = [(None, good[0]), (None, good[1]), (None, None), (None, ""), (900001, good[2]), (900001, good[3]), (900002, good[4]), (900002, good[4]), (900003, words), (900004, None)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, None, "odd" if i else None, len(t or "")) for i, t in own], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    extra = [F.lit(k).alias(k) for k in ("row", "id", "kind", "key", "digest", "taken", "kept", "node")]
    rows.select("*", *extra).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept, seen = rows.select("*", *extra), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), kept.schema)
        assert kept.columns == [*rows.columns, "row", "id", "kind", "key", "digest", "taken", "kept", "node"], name
        seen.append(kept.toPandas())
    quality, near = seen[:2]
    assert {good[0], good[1]} <= set(quality[quality.doc_id.isna()].text)
    assert quality.text.notna().all() and (quality.text != "").all()
    assert near.doc_id.dropna().is_unique
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*rows.columns, "row", "id", "kind", "key", "digest", "kept", "node", "size", "source_size", "target", "taken"]
    assert set(out.select("doc_id").toPandas().doc_id.dropna()) <= set(seen[3].doc_id.dropna())
    nothing = tmp_path / "nothing"
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(str(nothing / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0
