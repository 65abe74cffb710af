"""Functions on arrays, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed at once; the work grows with this and with the square of the array's blocks.
BLOCK = 256


def sums_before(values: Column) -> Column:
    """For each element of an integer array the sum of those before it (long); an empty array for an empty one, null for null.

    Sums run within blocks and over the blocks' totals, so long arrays are not copied for each element.
    """
    of = lambda xs, start: F.aggregate(
        xs, F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("ps")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["ps"], s["at"]).alias("ps")), lambda s: s["ps"],
    )
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    starts = of(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))
    found = F.flatten(F.zip_with(blocks, starts, lambda xs, start: of(xs, start)))
    return F.when(values.isNull(), F.lit(None)).when(n <= 0, F.array().cast("array<bigint>")).when(n <= BLOCK, of(values, F.lit(0))).otherwise(found)


def pairs(values: Column) -> Column:
    """The consecutive pairs (left, right) of an array; none for fewer than two elements, null for null."""
    n = F.size(values)
    made = F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(values.isNotNull(), made)


def first_of(values: Column, n: int) -> Column:
    """The first *n* elements."""
    return F.slice(values, 1, n)
