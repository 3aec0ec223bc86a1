"""Functions on array<float> vectors, folded in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column, dim: int) -> Column:
    """Right length, all entries finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column, least: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def fit(v: Column, dim: int) -> Column:
    """Truncated or padded with zeros to ``dim``."""
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim)).otherwise(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size(v))))
