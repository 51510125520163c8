"""Numbering and running sums by sampled ranges."""

import random

import pytest
from pyspark.sql import functions as F

from swarmframe.operators.order import numbered, running_sums


@pytest.mark.parametrize("kind", ["dense", "scattered", "few", "empty"])
def test_places_and_sums(spark, kind):
    rng = random.Random(1)
    keys = {"dense": range(5000), "scattered": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)], "few": [3, -1], "empty": []}[kind]
    rows = [(k, rng.choice([None, 0, 5, -2, 1 << 40])) for k in keys]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    got = numbered(df, [F.col("k")], "at").orderBy("k").collect()
    assert [(r.k, r.at) for r in got] == list(zip(sorted(keys), range(len(keys))))
    total, expected = 0, []
    for k, v in sorted(rows, key=lambda r: r[0]):
        expected.append((k, v, total))
        total += v or 0
    assert [tuple(r) for r in running_sums(df, [F.col("k")], "v", "before").orderBy("k").collect()] == expected


def test_no_window_over_rows(spark):
    df = spark.range(100_000).select(F.xxhash64("id").alias("k"), F.lit(1).alias("v"))
    out = running_sums(df, [F.col("k")], "v", "before")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1  # over the ranges
    assert out.filter("before < 0 or before >= 100000").count() == 0 and out.select("before").distinct().count() == 100_000
    ranges = spark.conf.get("spark.sql.shuffle.partitions")
    assert numbered(df, [F.desc("k")], "at").groupBy(F.spark_partition_id()).count().count() <= int(ranges)
