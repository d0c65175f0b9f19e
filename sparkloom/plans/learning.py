"""Trees, ensembles, votes, online learners and topics."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import strings as X
from ..operators import learning as O
from ..sources.tables import table

_FEATURES = ["quantity", "discount", "tax"]


def returns(spark, sf):
    """(id, quantity, discount, tax, returned, sign) of each line item."""
    x = table(spark, sf, "lineitem")
    late = (F.col("l_quantity") / 50 + F.col("l_discount") * 5 > 0.75).cast("int")
    return x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), late.alias("returned"), (late * 2 - 1).alias("sign"))


def _tree(name, how, **settings):
    def f(spark, sf):
        return O.trees(returns(spark, sf), _FEATURES, "returned", how, **settings)

    f.__name__ = name
    query()(f)


_tree("tree_gini", "tree", impurity="gini", maxDepth=5)
_tree("tree_entropy", "tree", impurity="entropy", maxDepth=5)
_tree("forest", "forest", numTrees=5, maxDepth=4)
_tree("boosted_trees", "boosted", maxIter=4, maxDepth=3)


def _online(how):
    def f(spark, sf):
        rows = O.seeded_batches(returns(spark, sf), "id", 8)
        w = O.online(rows, _FEATURES, "sign", how)
        return rows.select("id", (O.linear(_FEATURES, w) > 0).cast("int").alias("predicted"), "returned")

    f.__name__ = f"online_{how}"
    query()(f)


for _h in ("perceptron", "passive_aggressive", "sgd_momentum"):
    _online(_h)


_P = "p AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS a, CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS c FROM lineitem)"


@query(f"WITH {_P} SELECT id, CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END AS majority, CASE WHEN a * 0.5 + b * 0.3 + c * 0.2 >= 0.5 THEN 1 ELSE 0 END AS weighted, round((a + b + c) / 3.0::DOUBLE, 6) AS mean, round((a * 0.5 + b * 0.3 + c * 0.2)::DOUBLE, 6) AS weighted_mean FROM p")
def ensemble_votes(spark, sf):
    """Three models' answers by majority, by weight, and as means."""
    x = table(spark, sf, "lineitem")
    p = x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *[(F.col(c) > v).cast("int").alias(n) for n, c, v in (("a", "l_quantity", 30), ("b", "l_discount", 0.06), ("c", "l_tax", 0.04))])
    a, b, c = (F.col(n) for n in "abc")
    w = a * F.lit(5) + b * 3 + c * 2
    return p.select("id", (a + b + c >= 2).cast("int").alias("majority"), (w >= 5).cast("int").alias("weighted"), F.round((a + b + c) / 3.0, 6).alias("mean"), F.round(w / 10.0, 6).alias("weighted_mean"))


@query()
def topics(spark, sf):
    """Each item's largest of four topics."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    best, _ = O.topics(b, X.word_tokens(F.col("text")), 4)
    return best.select("id", "topic", F.round("share", 4).alias("share"))
