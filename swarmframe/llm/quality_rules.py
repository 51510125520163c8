"""Quality rules with an isolation forest over rule statistics.

Every whole text is counted (words, word characters, symbols, repeated lines,
repeated three-word windows). Two fixed rules reject at once; the others are
judged together: an isolation forest is grown on ratios of labelled good
documents, a document that few random splits isolate is anomalous, and the
anomaly score from which documents go is calibrated on the labelled rows.

Edge cases: a null or empty text has no words and fails the base rule; equal
texts get equal verdicts, and texts of any length are counted whole; without labelled good rows the base rules alone decide;
labels that are null, or given twice with different values, teach nothing; of a labelled id with several
texts the one of least statistics teaches; ids may be of any type; an
empty table gives an empty result. Extra columns are carried, or not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .text_stats import COUNTS, RATIOS, batch_stats

#: Labelled rows that the forest and its threshold are fitted on, at most (those with the smallest hash of their id).
MAX_LABELLED = 20_000
TREES, SAMPLE, SEED = 200, 64, 11
#: Cuts may lie outside a node's sample by so many times the good rows' range; with them in play, paths are longer than log2 of the sample.
MARGIN, MAX_DEPTH = 1.0, 24
#: Share of labelled good rows that may lie beyond the threshold.
MAX_GOOD_LOST = 0.002
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Ratios that the forest splits on: those that say something about the form of a text rather than its subject.
USED = [RATIOS.index(x) for x in ("word_len", "symbol", "dup_line", "repeat", "upper", "bang", "bar", "distinct")]


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points, by which path lengths are normalised."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, child for <= cut (the other is next to it), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the minus mean path length over its expectation."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                live = np.flatnonzero(f >= 0)
                if not len(live):
                    break
                here = at[live]
                at[live] = self.child[here] + (x[live, f[live]] > self.cut[here])
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(float(average_path(self.sample)), 1e-9))


def grow_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, margin: float = MARGIN) -> Forest:
    """Each split takes a random ratio and a random cut from the node's range widened by ``margin`` on both sides.

    Cuts beyond the range leave an empty child: what falls there later is isolated at once,
    so a document far out in one ratio has a short path even if the sample never went there.
    """
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    feature, cut, child, depth, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, -1), (cut, 0.0), (child, 0), (depth, 0.0)):
            column.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(node())
        open_nodes = [(roots[-1], rng.choice(len(x), size, replace=False), 0)]
        while open_nodes:
            i, rows, d = open_nodes.pop()
            if d >= MAX_DEPTH or len(rows) < 2:
                depth[i] = d + float(average_path(len(rows)))
                continue
            f = int(rng.integers(x.shape[1]))
            values = x[rows, f]
            feature[i], cut[i] = f, float(rng.uniform(values.min() - margin, values.max() + margin))
            left = values <= cut[i]
            child[i] = node()
            node()
            open_nodes += [(child[i], rows[left], d + 1), (child[i] + 1, rows[~left], d + 1)]
    return Forest(np.array(feature), np.array(cut), np.array(child), np.array(depth), np.array(roots), size)


@dataclass
class Rules:
    """What judges a text: the forest with its threshold (None: base rules only), and the scale of the ratios."""

    forest: Forest | None
    threshold: float
    low: np.ndarray
    high: np.ndarray

    def anomaly(self, ratios: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(ratios):
            return np.zeros(len(ratios))
        return self.forest.score(spread(ratios, self.low, self.high))

    def verdicts(self, counts: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, anomaly, kept) per row."""
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        anomaly = self.anomaly(ratios)
        return failed, anomaly, ~failed & (anomaly <= self.threshold)


def spread(ratios: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ratios in units of the good rows' range: values inside it stay close together, those outside reach further."""
    return np.clip((ratios[:, USED] - low) / np.maximum(high - low, 0.02), -4.0, 5.0)


def fit(counts: np.ndarray, ratios: np.ndarray, good: np.ndarray, max_good_lost: float = MAX_GOOD_LOST) -> Rules:
    """Grow on good rows, then cut where labelled rows are best told apart.

    The threshold minimises the sum of both error rates among cuts that lose no more than ``max_good_lost`` of the good rows.
    """
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    x, y = ratios[~failed], good[~failed]
    if y.sum() < 8:
        return Rules(None, 1.0, np.zeros(len(USED)), np.ones(len(USED)))
    low, high = np.quantile(x[y][:, USED], [0.002, 0.998], axis=0)
    forest = grow_forest(spread(x[y], low, high))
    rules = Rules(forest, 1.0, low, high)
    s = rules.anomaly(x)
    cuts = np.unique(s)
    good_s, bad_s = np.sort(s[y]), np.sort(s[~y])
    lost = 1 - np.searchsorted(good_s, cuts, "right") / len(good_s)
    passed = np.searchsorted(bad_s, cuts, "right") / max(len(bad_s), 1)
    cost = np.where(lost <= max_good_lost, lost + passed, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    nxt = np.append(cuts, 1.0)[best[-1] + 1]
    rules.threshold = float((cuts[best[-1]] + nxt) / 2)
    return rules


def stats_frame(docs: DataFrame) -> DataFrame:
    """doc_id, counts and ratios as arrays."""

    def run(batches):
        for b in batches:
            counts, ratios = batch_stats(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(ratios.tolist(), pa.list_(pa.float64()))], names=["doc_id", "counts", "ratios"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, counts array<bigint>, ratios array<double>")


def labelled_sample(labels: DataFrame, column: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id and good of at most ``limit`` ids whose label is known and not contradicted."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return known.filter("lo = hi").select("doc_id", (F.col("lo") > 0).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Rules:
    """Fit on the bounded labelled sample; ids (at most ``limit``) go out, their statistics come back."""
    sample = labelled_sample(labels, limit=limit)
    known = {r["doc_id"]: r["good"] for r in sample.collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in known], T.StructType([sample.schema["doc_id"]]))
    # of an id with several texts the one of least statistics, wherever the rows lie
    rows = stats_frame(docs.join(F.broadcast(ids), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min(F.struct("counts", "ratios")).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    counts = np.array([list(x) for x in rows["counts"]], np.int64).reshape(len(rows), len(COUNTS))
    ratios = np.array([list(x) for x in rows["ratios"]], np.float64).reshape(len(rows), len(RATIOS))
    return fit(counts, ratios, np.array([bool(known[i]) for i in rows["doc_id"]], bool))


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and anomaly of every row, in one pass and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)  # TREES trees over SAMPLE points: under 1 MB

    def run(batches):
        for b in batches:
            counts, ratios = batch_stats(b.column(1).to_pylist())
            failed, anomaly, kept = sent.value.verdicts(counts, ratios)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(anomaly)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.verdicts(*batch_stats(b.column(at).to_pylist()))[2]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
