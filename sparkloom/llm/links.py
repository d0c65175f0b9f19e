"""Linking rows through shared keys, and connected components, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bits_of, likely

#: Rows of small tables to a task; ids to a block of a group; members from which on a group may get another lead.
TASK_ROWS, BLOCK, LARGE = 50_000, 512, 64


def _tasks(rows: int) -> int:
    return 1 + rows // TASK_ROWS


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in edges (a, b): comp is the smallest id reachable.

    Large-star and small-star rounds alternate: each node's neighbours are hung on its smallest one, until every node hangs
    on a root. Edges never grow beyond one per node and round, and each round is a table in the shared folder. A hub's rows
    are split by adaptive execution as a skewed join.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(now, "edges", _tasks(edges.count()))
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        r = ends.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).alias("not_star")).first()
        if not r["not_star"]:
            break
        tasks = _tasks(r["n"])
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct(), "large", tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = scratch.table(small.where("u <> v").distinct(), "small", tasks)
        scratch.drop(now, large)
        now = nxt
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def joined_components(scratch: Scratch, comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """comp (id, comp), as a table, after links (ca, cb) between its components or ids that are in none yet."""
    if comp is not None and links.isEmpty():
        return comp
    more = scratch.table(components(scratch, links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "more")
    if comp is None:
        return more
    to = more.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    moved = comp.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = scratch.table(moved.union(more.join(comp.select("id"), "id", "left_anti").select("id", "comp")), "comp")
    scratch.drop(comp, more)
    return out


def link(scratch: Scratch, keys: DataFrame, items: Callable[[DataFrame], DataFrame], alike: Callable[[str, str], Column], ready: Callable[[str], Column] | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 2) -> DataFrame:
    """(id, comp) of the ids that are linked to another; keys: (key, id), an id once for each of its keys.

    Two ids with a common key are candidates. items gets the table of candidates' (id) and returns (id, p) with what a
    comparison needs; alike(a, b) is the condition on two such p; ready makes, behind the shuffle and once a row, of p what
    alike takes; confirm, where alike lets more than links through, keeps of pairs (a, b, ...) those that are links.

    Each key has its smallest id as lead, and all ids of the keys that share a lead form one group: so a family of alike ids,
    whose keys mostly have the same lead, meets once and not once a key. First every id is compared with its leads only. In
    groups that then still hold several components, ids outside the lead's are compared with those of others, block by
    block, inside the join's condition; pairs inside a component can't change it. Before, large groups whose lead has few alike get another
    lead, chosen by hash, while that settles pairs. So no link is lost, copies cost one comparison each, and only links leave
    a join; the comparisons within a family whose ids are nearly but not quite alike still grow with its square.
    """
    heads = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    heads = scratch.table(heads.select("key", "lead"), "heads")
    # Most keys have one id; only those that a set of the others may hold are shuffled again.
    again = likely(keys, "key", scratch.table(bits_of(heads, "key"), "bits"))
    met = scratch.table(again.join(heads, "key").select("lead", "id").distinct(), "met")
    scratch.drop(heads)
    ids = scratch.table(met.select("id").distinct(), "ids")
    rows = scratch.table(met.join(items(ids), "id").select("lead", "id", "p"), "rows")

    def dealt(df: DataFrame, p: str, *by: str) -> DataFrame:
        return df if ready is None else df.repartition(*by).withColumn(p, ready(p))

    # The members of a large group meet a copy of their lead in parts.
    parts = F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).cast("int")
    leads = rows.where("id = lead").join(met.groupBy("lead").agg(parts.alias("parts")), "lead")
    sizes = leads.where("parts > 1").select("lead", "parts")
    leads = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("p").alias("q"))
    others = rows.where("id <> lead").join(sizes, "lead", "left")
    others = others.select("lead", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "id", "p")
    star = dealt(others, "p", "lead", "part").join(dealt(leads, "q", "lead", "part"), ["lead", "part"]).where(alike("q", "p"))
    star = scratch.table(star.select(F.col("lead").alias("a"), F.col("id").alias("b")), "star")
    edges = star if confirm is None else scratch.table(confirm(star), "edges")
    comp = joined_components(scratch, None, edges.select(F.col("a").alias("ca"), F.col("b").alias("cb")))
    scratch.drop(star, edges, ids)
    before = float("inf")
    for turn in range(rounds + 1):
        placed = scratch.table(met.join(comp, "id", "left").select("lead", "id", F.coalesce("comp", "id").alias("comp")), "placed")
        per = placed.groupBy("lead", "comp").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("id") == F.col("lead")).cast("int")).alias("own"))
        groups = per.groupBy("lead").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("within"), F.sum(F.col("n") * F.col("own")).alias("near"), F.count(F.lit(1)).alias("comps"), F.max(F.when(F.col("own") == 1, F.col("comp"))).alias("main"))
        groups = scratch.table(groups.where("comps > 1").withColumn("hubless", F.expr(f"n >= {LARGE} AND 3 * near < n")), "groups")
        r = groups.where("hubless").agg(F.sum((F.col("n").cast("double") ** 2 - F.col("within")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
        if turn == rounds or not r["n"] or r["pairs"] <= 32 * r["n"] or r["pairs"] > before / 2:
            break
        before = r["pairs"]
        some = rows.join(placed.join(groups.where("hubless").select("lead"), "lead"), ["lead", "id"])
        other = some.groupBy("lead").agg(F.min_by(F.struct("id", "comp", "p"), F.xxhash64("id", F.lit(turn))).alias("o"))
        pairs = some.join(other, "lead").where(F.col("o.comp") != F.col("comp")).withColumn("q", F.col("o.p"))
        pairs = pairs if ready is None else pairs.withColumns({"p": ready("p"), "q": ready("q")})
        pairs = pairs.where(alike("q", "p")).select(F.least("o.id", "id").alias("a"), F.greatest("o.id", "id").alias("b"), F.col("o.comp").alias("ca"), F.col("comp").alias("cb")).distinct()
        found = scratch.table(pairs if confirm is None else confirm(scratch.table(pairs, "pairs")), "found")
        comp = joined_components(scratch, comp, found)
        scratch.drop(placed, groups)
    # Of two ids of different components one isn't in the lead's: those meet all others, block by block.
    open_ = placed.join(groups.select("lead", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lead")
    open_ = scratch.table(rows.join(open_, ["lead", "id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "open")
    scratch.drop(rows, met, placed, groups)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = open_.where("comp <> main").select("lead", F.col("block").alias("i"), others.alias("j"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("p").alias("q"))
    right = open_.select("lead", others.alias("i"), F.col("block").alias("j"), F.col("id").alias("b"), F.col("comp").alias("cb"), (F.col("comp") == F.col("main")).alias("main"), "p")
    pairs = dealt(left, "q", "lead", "i", "j").join(dealt(right, "p", "lead", "i", "j"), ["lead", "i", "j"]).where("ca <> cb AND (main OR a < b)").where(alike("q", "p"))
    pairs = scratch.table(pairs.select("a", "b", "ca", "cb").dropDuplicates(["a", "b"]), "pairs")
    found = pairs if confirm is None else scratch.table(confirm(pairs), "found")
    out = joined_components(scratch, comp, found)
    scratch.drop(open_, pairs, found)
    return out
