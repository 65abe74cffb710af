"""Vector functions on array columns; elements are widened to double before they are added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null, or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a null, empty or all-zero one and for different lengths."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def usable(a: Column) -> Column:
    """True for vectors that have a value other than zero."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))
