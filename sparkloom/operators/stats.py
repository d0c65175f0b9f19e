"""Statistics over one pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_trend(df: DataFrame, by: list[str], y: Column, x: Column) -> DataFrame:
    """(by..., slope, intercept, r2) by least squares; null where x does not vary."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def confidence(df: DataFrame, by: list[str], x: Column, z: float = 1.96) -> DataFrame:
    """(by..., mean, lo, hi): the mean and its interval by the normal distribution; null bounds for one row."""
    half = F.lit(z) * F.stddev_samp(x) / F.sqrt(F.count(x))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), (F.avg(x) - half).alias("lo"), (F.avg(x) + half).alias("hi"))


def elementwise(df: DataFrame, by: str, vector: str, how: str) -> DataFrame:
    """(by, i, x): the mean, sum, max or min of each coordinate, as rows, so that no group's vectors meet in one task."""
    each = df.select(by, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return each.groupBy(by, "i").agg({"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]("v").alias("x"))


def effect(df: DataFrame, x: Column, a: Column, b: Column) -> DataFrame:
    """(d, z): Cohen's d by the pooled deviation and the z statistic of two groups, from one pass."""
    of = {n: F.when(c, x) for n, c in (("a", a), ("b", b))}
    g = df.agg(*[f(of[n]).alias(f"{k}{n}") for n in "ab" for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    gap = F.col("ma") - F.col("mb")
    return g.select((gap / pooled).alias("d"), (gap / F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))).alias("z"))
