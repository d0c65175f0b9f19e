"""Blending, reranking and judging ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def min_max(hits: DataFrame, score: str) -> DataFrame:
    """hits with its score scaled to 0..1 over the list (1 where all are equal): one row of bounds is broadcast, nothing sorted."""
    bounds = hits.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    unit = F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(1.0)
    return hits.join(F.broadcast(bounds)).withColumn(score, unit).drop("__lo", "__hi")


def blend(dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, score): alpha of the scaled dense score and the rest of the scaled sparse one; a missing one counts 0."""
    d, s = (min_max(x.select("doc_id", F.col("score").alias(n)), n) for x, n in ((dense, "d"), (sparse, "s")))
    return d.join(s, "doc_id", "full").select("doc_id", (F.coalesce("d", F.lit(0.0)) * alpha + F.coalesce("s", F.lit(0.0)) * (1 - alpha)).alias("score"))


def weighted(signals: dict[str, float]) -> Column:
    """The mean of columns by weight; a null signal counts 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in signals.items()), F.lit(0.0)) / sum(signals.values())


def recency(age_days: Column, decay: float) -> Column:
    """exp(-decay * age / 30 days); 1 for what lies ahead."""
    return F.when(age_days <= 0, 1.0).otherwise(F.exp(-decay * age_days / 30))


def rocchio(query: Column, liked: Column, disliked: Column, a: float = 1.0, b: float = 0.75, g: float = 0.15) -> Column:
    """a * query + b * mean of the liked - g * mean of the disliked; null means count as zero."""
    part = lambda v, w: F.transform(query, lambda x, i: F.coalesce(F.get(v, i), F.lit(0.0)) * w)
    return F.zip_with(F.zip_with(F.transform(query, lambda x: x * a), part(liked, b), lambda x, y: x + y), part(disliked, g), lambda x, y: x - y)


def best_of(hits: DataFrame, id_col: str, score: str) -> DataFrame:
    """One row an id, with its best score: lists that overlap are merged by partial maxima."""
    return hits.groupBy(id_col).agg(F.max(score).alias(score))


def average_precision(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, ap, rr, hits): over lists (query, rank, vec_id) and relevant (query, n): precision at each hit, by |relevant|."""
    w = W.partitionBy("query").orderBy("rank")
    r = ranked.where(F.col("rank") <= k).withColumn("so_far", F.sum("hit").over(w))
    per = r.groupBy("query").agg(F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("total"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("hit").alias("hits"))
    return per.join(relevant, "query").select("query", F.coalesce(F.col("total") / F.least(F.col("n"), F.lit(k)), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "hits")
