"""Scalar functions for steps. NaN behaves as in IEEE comparisons: nothing compares with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def clamp(value, low, high) -> Column:
    v, lo, hi = as_double(value), as_double(low), as_double(high)
    return F.when(F.isnan(v), v).when(v < lo, lo).when(v > hi, hi).otherwise(v)


def safe_divide(numerator, denominator, default=0.0, tiny: float = 1e-30) -> Column:
    n, d = as_double(numerator), as_double(denominator)
    return F.when(~F.isnan(d) & (F.abs(d) > tiny), F.try_divide(n, d)).otherwise(as_double(default))


def lerp(a, b, t) -> Column:
    a = as_double(a)
    return a + as_double(t) * (as_double(b) - a)


def heaviside(x) -> Column:
    v = as_double(x)
    return F.when(~F.isnan(v) & (v >= 0), F.lit(1.0)).otherwise(F.lit(0.0))
