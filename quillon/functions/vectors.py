"""Vector expressions over arrays of floats, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm, which counts as 1e-12 at least."""
    n = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.element_at(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m)), 1)
