"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of every whole text are standardised and mapped to random cosines
whose inner products approximate a Gaussian kernel. Each partition of labelled
rows sums its normal equations, the sums are added up, and the driver solves one
system of fixed size. Raw scores become probabilities by isotonic regression on
labelled rows that the ridge fit has not seen, summed up in bins of raw score.

Edge cases: a null text counts as empty, and texts of any length are described whole; equal texts get equal scores; a score
of exactly the threshold is predicted 1; each text of a labelled id teaches, if several share it; ids may be of any type; labels
that are null, or given twice with different values, teach nothing; without
usable labels of both kinds every score is the mean label, or 0.5; an empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table
from .text_stats import RATIOS, batch_stats

#: Cosines, kernel width in standard deviations, ridge weight per row, raw-score bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 3.0, 1e-3, 512, 23
HELD_OUT, CALIBRATION = 2, 3  # remainders of crc32(doc_id) by 4


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


@dataclass
class Cosines:
    """Standardisation and random frequencies."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH) -> Cosines:
        rng = np.random.default_rng(SEED)
        return cls(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([wave, np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    cosines: Cosines | None
    beta: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots, not descending

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.cosines is None or not len(x):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.cosines(x) @ self.beta, self.knots, self.values), 0.0, 1.0)


def inputs(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Statistics that a score sees: the ratios, damped, and the log of the length."""
    return np.concatenate([np.sqrt(np.maximum(ratios, 0)), np.log1p(counts[:, :1])], axis=1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the not descending fit of least weighted squares."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w, strict=True):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, m, i), (b, k, j) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * k) / (m + k), m + k, i + j]]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def solve(gram: np.ndarray, right: np.ndarray, rows: float, ridge: float = RIDGE) -> np.ndarray:
    penalty = np.full(len(gram), ridge * rows)
    penalty[-1] = 1e-9 * rows  # the constant
    return np.linalg.solve(gram + np.diag(penalty), right)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics that a score sees, one pass over the texts."""

    def run(batches):
        for b in batches:
            x = inputs(*batch_stats(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(RATIOS) + 1).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def summed(rows: DataFrame, part, fan_in: int = 64) -> tuple[np.ndarray, ...]:
    """Add up what ``part(x, y)`` makes of each partition: once per partition, then ``fan_in`` sums at a time until no more than that are left, and these on the driver."""

    def one(batches):
        total = None
        for b in batches:
            if b.num_rows:
                new = part(matrix(b.column(0), len(RATIOS) + 1), np.asarray(b.column(1), np.float64))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    def more(batches):
        total = None
        for b in batches:
            for v in b.column(0):
                new = np.frombuffer(v.as_py())
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    sums = rows.select("x", "y").mapInArrow(one, "sum binary")
    partitions = rows.rdd.getNumPartitions()
    while partitions > fan_in:
        partitions = -(-partitions // fan_in)
        sums = sums.repartition(partitions).mapInArrow(more, "sum binary")
    found = [np.frombuffer(bytes(r[0])) for r in sums.collect()]
    return sum(found) if found else None


def learn(rows: DataFrame, features: int = FEATURES) -> Model:
    """Fit on ``rows`` of x, y (0 or 1) and part (``CALIBRATION`` calibrates, the others fit)."""
    rows = checkpointed(rows)
    fitted, held = rows.filter(F.col("part") != CALIBRATION), rows.filter(F.col("part") == CALIBRATION)
    width = len(RATIOS) + 1
    moments = summed(fitted, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if moments is None or moments[1] in (0, moments[0]):
        mean = 0.5 if moments is None else moments[1] / moments[0]
        return Model(None, np.zeros(0), np.zeros(1), np.array([mean]))
    n, mean = moments[0], moments[2 : 2 + width] / moments[0]
    cosines = Cosines.draw(mean, np.sqrt(np.maximum(moments[2 + width :] / n - mean**2, 0)), features)

    def equations(x, y):
        p = cosines(x)
        return np.concatenate([(p.T @ p).ravel(), p.T @ y])

    sums = summed(fitted, equations)
    d = features + 1
    beta = solve(sums[: d * d].reshape(d, d), sums[d * d :], n)

    def binned(x, y):
        at = np.clip(((cosines(x) @ beta + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]).astype(float)

    sums = summed(held, binned)
    if sums is None:
        sums = summed(fitted, binned)
    count, ones = sums[:BINS], sums[BINS:]
    full = np.flatnonzero(count)
    # half a label of the mean keeps sparse bins off 0 and 1
    share = (ones[full] + 0.5 * moments[1] / n) / (count[full] + 0.5)
    return Model(cosines, beta, (full + 0.5) / BINS * 2 - 0.5, isotonic(share, count[full]))


def scored(x_rows: DataFrame, model: Model) -> DataFrame:
    sent = x_rows.sparkSession.sparkContext.broadcast(model)  # features x statistics, BINS knots: under 1 MB

    def run(batches):
        for b in batches:
            s = sent.value.score(matrix(b.column(1), len(RATIOS) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), b.column(2)], names=["doc_id", "score", "held_out"])

    kind = x_rows.schema["doc_id"].dataType.simpleString()
    return x_rows.select("doc_id", "x", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")).mapInArrow(run, f"doc_id {kind}, score double, held_out boolean")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Texts are read once; statistics (15 numbers a row) are kept."""
    x_rows = checkpointed(described(docs))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    rows = x_rows.join(known, "doc_id").select("x", F.col("lo").cast("double").alias("y"), fold(F.col("doc_id")).alias("part"))
    out = scored(x_rows, learn(rows))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
