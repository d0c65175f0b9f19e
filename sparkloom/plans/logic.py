"""Logic and graph queries over edges derived from the tables."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph
from ..sources.tables import table

#: A forest: each supplier under the supplier with half its key.
_TREE = "e AS (SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey // 2 > 0)"
#: Supplies: suppliers and parts that occur together, as an undirected graph.
_TRADE = "e AS (SELECT DISTINCT c_custkey AS src, 1000000000 + c_custkey * 7 % 40 + c_nationkey * 100 AS dst FROM customer)"


def tree(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.floor(F.col("s_suppkey") / 2).alias("src"), F.col("s_suppkey").alias("dst")).where("src > 0")


def trade(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("src"), (F.lit(1000000000) + F.col("c_custkey") * 7 % 40 + F.col("c_nationkey") * 100).cast("long").alias("dst")).distinct()


@query(f"WITH {_TREE} SELECT a.src AS grandparent, b.dst AS grandchild FROM e a JOIN e b ON a.dst = b.src")
def datalog_grandparent(spark, sf):
    e = tree(spark, sf)
    return e.select(F.col("src").alias("grandparent"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("grandchild")), "mid").select("grandparent", "grandchild")


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT src, dst FROM t")
def datalog_ancestor(spark, sf):
    return graph.closure(tree(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON t.id = e.src) SELECT id, MIN(depth) AS depth FROM t GROUP BY id")
def bfs_depth(spark, sf):
    return graph.bfs(tree(spark, sf), spark.range(1, 2))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON t.id = e.src WHERE t.depth < 3) SELECT COUNT(*) AS within_3 FROM t")
def k_hop_count(spark, sf):
    return graph.bfs(tree(spark, sf), spark.range(1, 2), 3).agg(F.count(F.lit(1)).alias("within_3"))


@query(f"WITH {_TRADE} SELECT id, MIN(src) OVER (PARTITION BY hub) AS comp FROM (SELECT src AS id, src, dst AS hub FROM e UNION ALL SELECT DISTINCT dst, NULL, dst FROM e)")
def connected_components(spark, sf):
    return graph.components(trade(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 1::BIGINT AS id, 0 AS level UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON t.id = e.src) SELECT id, level FROM t")
def topological_levels(spark, sf):
    return graph.levels(tree(spark, sf))


@query(f"WITH {_TREE}, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, SUM(o)::BIGINT AS out_degree, SUM(i)::BIGINT AS in_degree FROM d GROUP BY id")
def degrees(spark, sf):
    e = tree(spark, sf)
    d = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return d.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query(f"WITH {_TREE}, n AS (SELECT COUNT(*) AS v FROM (SELECT src FROM e UNION SELECT dst FROM e)) SELECT round(2.0::DOUBLE * (SELECT COUNT(*) FROM e) / (v * (v - 1.0::DOUBLE)), 9) AS density FROM n")
def graph_density(spark, sf):
    e = tree(spark, sf)
    v = e.select("src").union(e.select("dst")).agg(F.countDistinct("src").alias("v")).join(e.agg(F.count(F.lit(1)).alias("m")))
    return v.select(F.round(2.0 * F.col("m") / (F.col("v") * (F.col("v") - 1.0)), 9).alias("density"))
