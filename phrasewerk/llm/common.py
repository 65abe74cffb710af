"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasewerk.sources.store import shared_dir, written
from phrasewerk.tables import table

__all__ = ["has_word", "shared_dir", "table", "usable_vector", "written"]


def usable_vector(vector: Column, dim: int = 64) -> Column:
    """True for vectors of *dim* values that are not all zero; false for null, short, NaN or infinite ones."""
    number = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & number(x)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def has_word(text: Column) -> Column:
    """True if *text* has a letter or digit."""
    return text.rlike(r"[\p{L}\p{N}]")
