"""Cluster quality and score fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n) of rows that have both."""
    return rows.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row (purity): the share of rows that have their cluster's most frequent label; null for no rows."""
    top = contingency(rows, cluster, label).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return top.agg((F.sum("top") / F.sum("all")).alias("purity"))


def adjusted_rand(rows: DataFrame, cluster: str, label: str, min_clusters: int = 1) -> DataFrame:
    """One row (ari): the adjusted Rand index; 1 where expected and possible agreement are equal, 0 under *min_clusters* clusters."""
    cells = contingency(rows, cluster, label)
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    both = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("n"), F.countDistinct("cluster").alias("k"))
    a = cells.groupBy("cluster").agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("a"))
    b = cells.groupBy("label").agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("b"))
    one = both.crossJoin(a).crossJoin(b)  # one row each
    expected = F.col("a") * F.col("b") / F.nullif(two("n"), F.lit(0.0))
    most = (F.col("a") + F.col("b")) / 2
    ari = F.when(F.col("k") < min_clusters, 0.0).otherwise(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)))
    return one.select(ari.alias("ari"))


def harmonic(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by..., mean_score, n, fused): 2 * mean * n / (mean + n) of each class; 0 for a sum of 0."""
    rows = scores.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))
    total = F.col("mean_score") + F.col("n")
    return rows.withColumn("fused", F.when(total == 0, 0.0).otherwise(2 * F.col("mean_score") * F.col("n") / total))
