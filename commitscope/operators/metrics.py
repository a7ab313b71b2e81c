"""Retrieval and sample metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running


def precision_at_k(ranked, expected, k: int):
    """Mean over rows of whether ``expected`` is among the first k of ``ranked``."""
    return F.coalesce(F.avg(F.array_contains(F.slice(ranked, 1, k), expected).cast("double")), F.lit(0.0))


def mrr(ranked, expected):
    at = F.array_position(ranked, expected)
    return F.coalesce(F.avg(F.when(at > 0, 1.0 / at).otherwise(0.0)), F.lit(0.0))


def nearest_ranks(df: DataFrame, value: str, *percents: float) -> DataFrame:
    """One row with the nearest-rank percentiles ``p50`` and so on: the smallest value with at least that share of the rows at or below it.

    Values are counted first; their running counts come from buckets, so no task holds all values.
    """
    c = running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, "n")
    total = F.lit(df.where(F.col(value).isNotNull()).count())
    return c.agg(*[F.min(F.when(F.col("before") + F.col("n") >= F.greatest(F.ceil(total * p / 100), F.lit(1)), F.col(value))).alias(f"p{p:g}") for p in percents])


def jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the true group and the z of its normal approximation with tie and continuity correction.

    Values are counted first, and their ranks come from running counts by bucket.
    """
    c = df.groupBy(value).agg(F.sum(F.col(group).cast("int").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    r = running(c, value, "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    s = r.agg(F.sum(F.col("rank") * F.col("hits")).alias("r"), F.sum("hits").cast("double").alias("n1"), F.sum("n").cast("double").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    d = u - n1 * n2 / 2
    return s.select(u.alias("u"), ((d - F.signum(d) * 0.5) / sigma).alias("z"))
