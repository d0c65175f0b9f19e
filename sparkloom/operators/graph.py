"""Graph and recursive logic: semi-naive fixpoints over DataFrames, each round a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, kept


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder. Unlike a checkpoint, it is computed once and carries neither estimates
    nor constraints on, which would multiply with every round in the driver."""
    return kept(df, "round")


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """All rows derivable: step gets the rows new in the last round, and gives candidates; set semantics."""
    known = new = _cut(base.distinct())
    n = 0
    while (rounds is None or n < rounds) and not new.isEmpty():
        new = _cut(step(new).distinct().join(known.hint("merge"), base.columns, "left_anti").select(*base.columns))
        known = known.union(new)
        n += 1
    return known


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs with a path of one edge or more."""
    e = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    return fixpoint(edges.select("src", "dst"), lambda new: new.join(e, new["dst"] == e["mid"]).select("src", F.col("to").alias("dst")))


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth) of every node within `depth` edges of a root (all that are reachable, if None); roots have depth 0."""
    known = new = _cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    e, d = edges.select("src", F.col("dst").alias("id")), 0
    while (depth is None or d < depth) and not new.isEmpty():
        d += 1
        step = new.select(F.col("id").alias("src")).join(e, "src").select("id").distinct()
        new = _cut(step.join(known.select("id").hint("merge"), "id", "left_anti").withColumn("depth", F.lit(d)))
        known = known.union(new)
    return known


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable without regard to direction; labels jump to their label's label each round.

    Labels are as many as nodes, so they are merged and never broadcast, and what says whether any moved is formed with them.
    """
    spark = edges.sparkSession
    both = _cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = _cut(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("comp")).select(F.col("src").alias("id"), "comp", F.lit(True).alias("moved")))
    while not label.where("moved").isEmpty():
        near = both.hint("merge").join(label.select(F.col("id").alias("dst"), "comp"), "dst").groupBy("src").agg(F.min("comp").alias("low"))
        least = label.hint("merge").join(near, label["id"] == near["src"]).select("id", F.col("comp").alias("was"), F.least("comp", "low").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        comp = F.least("low", F.coalesce("far", "low"))
        nxt = _cut(least.join(jump.hint("merge"), "low", "left").select("id", comp.alias("comp"), (comp != F.col("was")).alias("moved")))
        dropped(spark, label)
        label = nxt
    dropped(spark, both)
    return label.select("id", "comp")


def levels(edges: DataFrame) -> DataFrame:
    """(id, level) of an acyclic graph: the longest path from a source; nodes on or behind a cycle have none."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    left, done, level = _cut(edges.select("src", "dst")), None, 0
    open_ = _cut(nodes)
    while not open_.isEmpty():
        ready = _cut(open_.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        open_ = _cut(open_.join(ready.select("id"), "id", "left_anti"))
        left = _cut(left.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else nodes.limit(0).withColumn("level", F.lit(0))


def least_costs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cost) of the cheapest way from a root over (src, dst, w), w >= 0: rounds relax only what got cheaper."""
    known = new = _cut(roots.select("id").distinct().withColumn("cost", F.lit(0).cast(dict(edges.dtypes)["w"])))
    e = edges.select("src", F.col("dst").alias("id"), "w")
    while not new.isEmpty():
        step = new.select(F.col("id").alias("src"), F.col("cost").alias("so_far")).join(e, "src").groupBy("id").agg(F.min(F.col("so_far") + F.col("w")).alias("cost"))
        before = known.withColumnRenamed("cost", "was")
        new = _cut(step.join(before.hint("merge"), "id", "left").where("was IS NULL OR cost < was").select("id", "cost"))
        known = _cut(known.union(new).groupBy("id").agg(F.min("cost").alias("cost")))
    return known


def fewest_hops(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, hops, path): a way of fewest edges from a root, the first in the order of its text if there are several."""
    known = new = _cut(roots.select("id").distinct().select("id", F.lit(0).alias("hops"), F.col("id").cast("string").alias("path")))
    e, n = edges.select("src", F.col("dst").alias("id")), 0
    while not new.isEmpty():
        n += 1
        step = new.select(F.col("id").alias("src"), "path").join(e, "src").groupBy("id").agg(F.min(F.concat_ws(">", "path", F.col("id").cast("string"))).alias("path"))
        new = _cut(step.join(known.select("id").hint("merge"), "id", "left_anti").select("id", F.lit(n).alias("hops"), "path"))
        known = known.union(new)
    return known


def link_rank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) after some rounds in which a node hands its rank in equal parts to those it links to."""
    e = _cut(edges.select("src", "dst").join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src"))
    nodes = _cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    total = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(total, 1)))
    for _ in range(rounds):
        given = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("given"))
        rank = _cut(nodes.join(given, "id", "left").select("id", (F.lit((1 - damping) / max(total, 1)) + damping * F.coalesce("given", F.lit(0.0))).alias("rank")))
    return rank
