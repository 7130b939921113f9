"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column, n: Column) -> Column:
    return F.transform(F.slice(c, F.lit(1), n), lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; vectors are cut to the shorter one, and null, empty or zero vectors give 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = _doubles(a, n), _doubles(b, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(a.isNull() | b.isNull() | (n <= 0), 0.0).when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def hybrid(keyword: Column, similarity: Column, weight: float) -> Column:
    """Keyword score (40 and more count as 1) and similarity, blended."""
    return F.least(keyword / 40.0, F.lit(1.0)) * (1 - weight) + similarity * weight
