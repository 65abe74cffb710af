"""Consecutive numbers for an ordered table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.sources.store import written


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """*rows* with numbers from *first* on in *order* (which must be unique).

    The rows are parted by ranges of the order; each part is numbered by itself from the sum of the parts before it.
    """
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parted = written(parted, "numbered")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # one row for each part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.join(F.broadcast(starts), "_part").withColumn(name, inside - 1 + F.col("_before") + F.lit(first)).drop("_part", "_before")
