"""Numbering and running sums in an order, without a window over all rows.

Rows are dealt into ranges of a sampled order, so that ranges have about equal many rows whatever the keys are; each range is numbered where it is,
and what the ranges before hold is added: one row per range. A checkpoint keeps the ranges as they were dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

RANGE, PLACE, RUN = "range__", "place__", "run__"
#: Rows of a range, where their number is known.
ROWS = 1_000_000


def dealt(df: DataFrame, order: list[Column], rows: int = 0) -> DataFrame:
    """Rows in order, with the number of their range and their place in it. rows: how many there are, if known."""
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    out = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return out.withColumn(RANGE, F.spark_partition_id()).withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _upto(ranges: DataFrame) -> DataFrame:
    """range, and the total of the ranges before. One row per range in the only window, and in what is broadcast."""
    return F.broadcast(ranges.select(RANGE, (F.sum("total__").over(Window.orderBy(RANGE)) - F.col("total__")).alias("before__")))


def numbered(df: DataFrame, order: list[Column], out: str, rows: int = 0) -> DataFrame:
    """``df`` and each row's place in the order, from 0, as a long. The order should tell all rows apart: equal rows are one range."""
    kept = cut(dealt(df, order, rows))
    before = _upto(kept.groupBy(RANGE).agg(F.count(F.lit(1)).alias("total__")))
    return kept.join(before, RANGE).withColumn(out, F.col(PLACE) + F.col("before__")).drop(RANGE, PLACE, "before__")


def running_sums(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` and the sum of ``value`` (a long, null counts as 0) over the rows before each, in the order."""
    rows = dealt(df.withColumn(RUN, F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))), order)
    at = rows.columns.index(RUN)

    def run(batches):
        total = 0
        for b in batches:
            ends = total + np.cumsum(np.asarray(b.column(at)))
            here = np.concatenate([[total], ends[:-1]]) if len(ends) else ends
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    kept = cut(rows.mapInArrow(run, rows.schema))
    amount = F.sum(F.coalesce(F.col(value).cast("long"), F.lit(0)))
    before = _upto(kept.groupBy(RANGE).agg(amount.alias("total__")))
    return kept.join(before, RANGE).withColumn(out, (F.col(RUN) + F.col("before__")).cast("long")).drop(RANGE, PLACE, RUN, "before__")


def places_within(df: DataFrame, group: str, order: list[Column], out: str, rows: int = 0) -> DataFrame:
    """``df`` and each row's place among those of its group (a long column), from 0: numbers of all rows less the group's least one, so that a large group is no task's own."""
    placed = numbered(df, [F.col(group), *order], "number__", rows)
    # another name for the key: the planner does not reuse the sum's partitions then, and adaptive execution can split a large group
    first = placed.groupBy(group).agg(F.min("number__").alias("first__")).withColumn(group, F.col(group).bitwiseXOR(F.lit(0).cast("long")))
    return placed.join(first, group).withColumn(out, F.col("number__") - F.col("first__")).drop("number__", "first__")
