"""Vectors as column expressions: arrays of numbers, taken as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, least: float = 1e-9) -> Column:
    """The vector at length 1; as it is if it has hardly any length."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > least, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; 1 for other lengths or no direction."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 1e-12), F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / n))).otherwise(1.0)
