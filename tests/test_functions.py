"""Random numbers against exact integer arithmetic, and scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swarmframe.functions import math as fn
from swarmframe.functions import rng

GOLDEN = [(42, 0, 0, 1, 0.025429606437683105), (42, 0, 1, 1, 0.8586417436599731), (42, 1, 0, 1, 0.5032593011856079), (999, 3, 7, 1, 0.8665975332260132), (2147483647, 99, 123456, 2, 0.5677284002304077)]
XORSHIFT = [(42, 0, 0, 1, 0.970456), (42, 0, 1, 1, 0.514987), (42, 1, 0, 1, 0.529568), (999, 3, 7, 1, 0.838955), (2147483647, 99, 123456, 2, 0.627345)]
NORMAL = [(42, 0, 0, 1, 2.2238366183654197), (42, 0, 1, 1, 0.3775828546507677), (7, 0, 3, 1, -0.529874089856264)]


def plain_philox(seed, tick, ident, salt):
    a, b = (tick * 1000003 + salt) % 2**32, ident % 2**32
    for r in range(10):
        p = a * 3529668003
        a, b = (p >> 32) ^ ((seed + r * 2654435769) % 2**32) ^ b, p % 2**32
    return a % 2**23 / 2**23


@pytest.mark.parametrize(("make", "rows", "close"), [(rng.uniform, GOLDEN, 0), (rng.uniform_xorshift, XORSHIFT, 0), (rng.normal, NORMAL, 1e-12)])
def test_golden(spark, make, rows, close):
    df = spark.createDataFrame([r[:4] for r in rows], "s bigint, t bigint, i bigint, k bigint")
    got = [r[0] for r in df.select(make(F.col("s"), F.col("t"), F.col("i"), F.col("k"))).collect()]
    assert got == pytest.approx([r[4] for r in rows], abs=close, rel=0)
    one = [spark.range(1).select(make(s, t, i, k)).head()[0] for s, t, i, k, _ in rows[:2]]
    assert one == pytest.approx([r[4] for r in rows[:2]], abs=close, rel=0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 10**6), st.integers(0, 2**40), st.integers(0, 10**6)), min_size=1, max_size=40))
def test_philox_equals_exact_integers(spark, rows):
    df = spark.createDataFrame(rows, "s bigint, t bigint, i bigint, k bigint")
    got = [r[0] for r in df.select(rng.uniform(F.col("s"), F.col("t"), F.col("i"), F.col("k"))).collect()]
    assert got == [plain_philox(*r) for r in rows]


def test_moments_and_ranges(spark):
    df = spark.range(50000).select(rng.normal(7, 0, F.col("id"), 1).alias("z"), rng.uniform(7, 0, F.col("id"), 1).alias("u"), rng.uniform_xorshift(7, 0, F.col("id"), 1).alias("x"), rng.normal_bounded(7, 0, F.col("id"), 1, -1, 1).alias("b"))
    r = df.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("b").alias("b0"), F.max("b").alias("b1")).head()
    assert r.m == pytest.approx(0.0051762, abs=1e-6)
    assert r.s == pytest.approx(0.9978685, abs=1e-6)
    assert r.u0 >= 0 and r.u1 < 1 and r.x0 >= 0 and r.x1 < 1 and (r.b0, r.b1) == (-1, 1)


def test_salts_differ(spark):
    n = spark.range(1000).filter(rng.uniform(1, 0, F.col("id"), 1) == rng.uniform(1, 0, F.col("id"), 2)).count()
    assert n < 5


def test_scalars(spark):
    nan = math.nan
    ask = lambda c: spark.range(1).select(c).head()[0]
    assert [ask(fn.clamp(v, 0, 10)) for v in (-1.0, 5.0, 11.0)] == [0, 5, 10]
    assert math.isnan(ask(fn.clamp(nan, 0, 10)))
    assert [ask(fn.safe_divide(10, 2)), ask(fn.safe_divide(10, 0, -1)), ask(fn.safe_divide(1, 4)), ask(fn.safe_divide(1, nan, 7))] == [5, -1, 0.25, 7]
    assert [ask(fn.lerp(0, 10, t)) for t in (0, 0.5, 1)] == [0, 5, 10]
    assert [ask(fn.heaviside(v)) for v in (-0.1, 0.0, 3.0, nan)] == [0, 1, 1, 0]
