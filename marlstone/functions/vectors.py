"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    """Divided by its length, which counts as ``floor`` at least."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
