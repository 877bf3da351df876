"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def masked(v: Column, present: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.when(present, x).otherwise(0.0))


def first_maximum(v: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def top_margin(v: Column) -> Column:
    """Largest minus second largest element."""
    s = F.sort_array(v, asc=False)
    return F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2))


def half_margin(v: Column) -> Column:
    """Smallest distance of an element to 0.5."""
    return F.array_min(F.transform(v, lambda x: F.abs(x - 0.5)))
