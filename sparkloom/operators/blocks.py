"""Ranks, running sums and exact quantiles within groups of any size: a group is cut into blocks at its approximate quantiles,
and each block goes on from the totals of those before it. Equal values lie in one block; what is approximate is only where
the cuts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS = 64


def blocked(df: DataFrame, by: Sequence[str], order: str, blocks: int = BLOCKS) -> DataFrame:
    """df with __block: how many of its group's cuts lie below the row's value; null values come first."""
    cuts = F.percentile_approx(order, F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(10 * blocks))
    own = [F.col(f"`{c}`") for c in df.columns]
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))
    if not by:
        return df.join(F.broadcast(df.agg(cuts.alias("__cuts")))).select(*own, F.when(F.col(order).isNull(), -1).otherwise(at).alias("__block"))
    table = df.groupBy(*[F.col(c).alias(f"__by_{c}") for c in by]).agg(cuts.alias("__cuts"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(table, same).select(*own, F.when(F.col(order).isNull(), -1).otherwise(at).alias("__block"))


def _carried(df: DataFrame, by: Sequence[str], total: Column, down: bool) -> DataFrame:
    """df (with __block) with __before: the total of its group's blocks that come first."""
    t = df.groupBy(*by, "__block").agg(total.alias("__t"))
    order = F.desc("__block") if down else F.asc("__block")
    before = F.coalesce(F.sum("__t").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__block").alias("__k"), before.alias("__before"))
    same = F.col("__block") == F.col("__k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return df.join(t, same).drop("__k", *[f"__k_{c}" for c in by])


def ranks(df: DataFrame, by: Sequence[str], order: str, tie: str, down: bool = True, name: str = "rank") -> DataFrame:
    """df with its rows' places in their groups, from 1."""
    x = _carried(blocked(df, by, order), by, F.count(F.lit(1)), down)
    w = W.partitionBy(*by, "__block").orderBy(F.desc(order) if down else F.asc(order), tie)
    return x.withColumn(name, (F.row_number().over(w) + F.col("__before")).cast("long")).drop("__block", "__before")


def running_sums(df: DataFrame, by: Sequence[str], order: str, value: str, down: bool, name: str) -> DataFrame:
    """df with the sum of the values up to each row of its group; order is to be without ties."""
    x = _carried(blocked(df, by, order), by, F.sum(value), down)
    w = W.partitionBy(*by, "__block").orderBy(F.desc(order) if down else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn(name, F.sum(value).over(w) + F.col("__before")).drop("__block", "__before")


def quantiles(df: DataFrame, by: Sequence[str], value: str, tie: str, shares: Sequence[float]) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles, between two places by interpolation; nulls don't count."""
    rows = df.select(*by, value, tie).where(F.col(value).isNotNull())
    r = ranks(rows, by, value, tie, down=False, name="__rank")
    n = rows.groupBy(*[F.col(c).alias(f"__n_{c}") for c in by]).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    r = r.join(n, same)

    def one(q: float) -> Column:
        place = F.lit(q) * (F.col("__n") - 1) + 1
        low, high = F.floor(place), F.ceil(place)
        part = place - low
        weight = F.when(F.col("__rank") == low, F.when(low == high, 1.0).otherwise(1 - part)).when(F.col("__rank") == high, part)
        return F.sum(weight * F.col(value))

    return r.groupBy(*by).agg(*[one(q).alias(f"q{i}") for i, q in enumerate(shares)])
