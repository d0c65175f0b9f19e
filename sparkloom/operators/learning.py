"""Learners whose state fits in a row: rounds of gradients over seeded mini-batches, votes, trees and topics by Spark's own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_batches(rows: DataFrame, key: str, batches: int) -> DataFrame:
    """rows with `batch`, dealt by a hash of the key, so that a rerun takes the same ones."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(batches)).cast("int"))


def online(rows: DataFrame, features: list[str], label: str, how: str, rate: float = 0.1, momentum: float = 0.9, c: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) after one pass over the batches, in their order; labels are -1 and 1.

    perceptron adds up the batch's mistakes; passive_aggressive the steps that would right each row, cut at c; sgd_momentum
    follows the logistic loss. A batch is one job of partial sums over its rows, as long as there are features.
    """
    w = np.zeros(len(features) + 1)
    v = np.zeros_like(w)
    x = [F.coalesce(F.col(f), F.lit(0.0)) for f in features] + [F.lit(1.0)]
    rows = rows.where(F.col(label).isin(-1, 1)).persist()
    for (b,) in rows.select("batch").distinct().orderBy("batch").collect():
        y, score = F.col(label), sum((F.lit(float(k)) * f for k, f in zip(w, x, strict=True)), F.lit(0.0))
        size = sum((f * f for f in x), F.lit(0.0))
        step = {"perceptron": F.when(y * score <= 0, y).otherwise(0), "passive_aggressive": y * F.least(F.lit(c), F.greatest(F.lit(0.0), 1 - y * score) / size), "sgd_momentum": y / (1 + F.exp(y * score))}[how]
        n, *g = rows.where(F.col("batch") == b).agg(F.count(F.lit(1)), *[F.sum(step * f) for f in x]).first()
        g = np.array(g, float) / max(n, 1)
        v = momentum * v + rate * g if how == "sgd_momentum" else g
        w = w + v
    rows.unpersist()
    return w


def linear(features: list[str], w: np.ndarray) -> Column:
    return sum((F.coalesce(F.col(f), F.lit(0.0)) * float(k) for f, k in zip(features, w, strict=False)), F.lit(float(w[-1])))


def assembled(rows: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = ["id"] + ([label] if label else [])
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows).select(*cols, "features")


def trees(rows: DataFrame, features: list[str], label: str, how: str, **settings) -> DataFrame:
    """(id, predicted) of a single tree (gini or entropy), a forest or boosted trees; fitted and applied by Spark."""
    from pyspark.ml import classification as C

    made = {"tree": C.DecisionTreeClassifier, "forest": C.RandomForestClassifier, "boosted": C.GBTClassifier}[how]
    data = assembled(rows, features, label)
    model = made(labelCol=label, featuresCol="features", seed=7, **settings).fit(data)
    return model.transform(data).select("id", F.col("prediction").cast("int").alias("predicted"))


def topics(docs: DataFrame, words: Column, k: int, rounds: int = 10, vocabulary: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(id, topic, share) of each text's largest topic, and (topic, term, weight) of each topic's ten first terms."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    d = docs.select("id", words.alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary).fit(d)
    data = counts.transform(d)
    model = LDA(k=k, maxIter=rounds, seed=7).fit(data)
    p = model.transform(data).select("id", vector_to_array("topicDistribution").alias("p"))
    best = p.select("id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("topic"), F.array_max("p").alias("share"))
    terms = F.array(*[F.lit(t) for t in counts.vocabulary])
    rows = model.describeTopics(10).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    return best, rows.select("topic", F.get(terms, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))
