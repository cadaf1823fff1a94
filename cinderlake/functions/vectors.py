"""Vector expressions in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine similarity; 1 where either vector has no length."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.when(scale == 0, F.lit(1.0)).otherwise(scale))
