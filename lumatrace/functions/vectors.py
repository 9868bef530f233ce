"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers, not all of them zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, rounded to six decimals; null for a zero vector."""
    return F.round(1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), 6)


def threshold_distance(percent: float) -> float:
    return round(1 - percent / 100, 6)
