"""Array properties: element writes, padding, vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _index(i) -> Column:
    return i if isinstance(i, Column) else F.lit(i)


def set_at(array: Column, index, value) -> Column:
    """The array with element ``index`` (modulo its size) replaced: a circular buffer's write."""
    at = F.pmod(_index(index), F.size(array))
    return F.transform(array, lambda x, i: F.when(i == at, value).otherwise(x))


def get_at(array: Column, index) -> Column:
    """Element ``index`` modulo the array's size; null in an empty array."""
    return F.get(array, F.when(F.size(array) > 0, F.pmod(_index(index), F.greatest(F.size(array), F.lit(1)))).cast("int"))


def pad(array: Column, size: int, fill: float = float("nan")) -> Column:
    """Rows of one width: ragged arrays filled up at the end."""
    return F.concat(array, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(array), F.lit(0))))


def unpad(array: Column) -> Column:
    """What padding with NaN has added, removed."""
    return F.filter(array, lambda x: ~F.isnan(x))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean_of_products(total_a: Column, total_b: Column, size) -> Column:
    """Mean over all pairs of elements of two vectors, from their totals: the double sum separates."""
    return total_a * total_b / (F.lit(float(size)) * F.lit(float(size)) if not isinstance(size, Column) else size * size)
