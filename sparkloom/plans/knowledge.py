"""Facts, rules, versions, entities, graphs with cycles, temporal edges, intervals and event patterns."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import strings as X
from ..operators import graph, temporal
from ..operators import rules as L
from ..operators.temporal import micros
from ..sources.tables import table
from .analytics import _SNAP, _snapshots
from .logic import _TREE, tree

#: Chains and cycles: each part links down by its size and some to the next one, within blocks of 50.
_LINKS = "l AS (SELECT p_partkey AS src, p_partkey - p_size AS dst FROM part WHERE p_partkey - p_size >= 0 AND (p_partkey - p_size) // 50 = p_partkey // 50 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_size % 10 = 0 AND (p_partkey + 1) // 50 = p_partkey // 50)"
_REACH = f"WITH RECURSIVE {_LINKS}, t AS (SELECT src, dst FROM l UNION SELECT t.src, l.dst FROM t JOIN l ON t.dst = l.src) "


def links(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("size"))
    down = p.select("src", (F.col("src") - F.col("size")).alias("dst")).where("dst >= 0")
    on = p.where("size % 10 = 0").select("src", (F.col("src") + 1).alias("dst"))
    return down.union(on).where("floor(src / 50) = floor(dst / 50)").distinct()


@query(f"WITH RECURSIVE {_LINKS}, b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), t AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON t.dst = b.src) SELECT src AS id, least(src, MIN(dst)) AS comp FROM t GROUP BY src")
def chain_components(spark, sf):
    """Components of a graph of chains and cycles."""
    return graph.components(links(spark, sf))


@query(f"WITH RECURSIVE {_LINKS}, b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), t AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON t.dst = b.src), c AS (SELECT src AS id, least(src, MIN(dst)) AS comp FROM t GROUP BY src), n AS (SELECT comp, COUNT(*) AS members FROM c GROUP BY comp HAVING COUNT(*) >= 10), e AS (SELECT comp, COUNT(*) AS links FROM l JOIN c ON id = src GROUP BY comp) SELECT comp, members, links, round(links / (members * (members - 1))::DOUBLE, 6) AS cohesion FROM n JOIN e USING (comp)")
def communities(spark, sf):
    """Components of ten members or more, and how densely they are linked."""
    e = links(spark, sf)
    c = graph.components(e)
    n = c.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members >= 10")
    k = e.join(c, e["src"] == c["id"]).groupBy("comp").agg(F.count(F.lit(1)).alias("links"))
    return n.join(k, "comp").select("comp", "members", "links", F.round(F.col("links") / (F.col("members") * (F.col("members") - 1)), 6).alias("cohesion"))


@query(_REACH + "SELECT src AS id FROM t WHERE src = dst")
def cycle_nodes(spark, sf):
    """Nodes that reach themselves."""
    return graph.closure(links(spark, sf)).where("src = dst").select(F.col("src").alias("id"))


@query(_REACH + "SELECT COUNT(*) > 0 AS has_cycle FROM t WHERE src = dst")
def has_cycle(spark, sf):
    """Whether any edge stays when nodes without an edge into them are taken away round by round: no closure is formed."""
    e = links(spark, sf)
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    left = nodes.join(graph.levels(e).select("id"), "id", "left_anti")
    return left.agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


@query(_REACH + ", v AS (SELECT src AS id FROM l UNION SELECT dst FROM l), bad AS (SELECT DISTINCT id FROM v JOIN (SELECT src AS c FROM t WHERE src = dst) ON id = c OR EXISTS (SELECT 1 FROM t WHERE t.src = c AND t.dst = id)) SELECT id, id NOT IN (SELECT id FROM bad) AS stratified FROM v")
def stratification(spark, sf):
    """Which nodes have a stratum: not those on or behind a cycle."""
    e = links(spark, sf)
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(graph.levels(e), "id", "left").select("id", F.col("level").isNotNull().alias("stratified"))


@query(f"WITH {_LINKS}, d0 AS (SELECT DISTINCT src AS id FROM l WHERE src % 50 = 49), d1 AS (SELECT id FROM d0 UNION SELECT dst FROM d0 JOIN l ON src = id), d2 AS (SELECT id FROM d1 UNION SELECT dst FROM d1 JOIN l ON src = id) SELECT l.src, l.dst FROM l WHERE src IN (SELECT id FROM d2) AND dst IN (SELECT id FROM d2)")
def subgraph(spark, sf):
    """The edges among what is within two steps of a set of roots."""
    e = links(spark, sf)
    near = graph.bfs(e, e.where("src % 50 = 49").select(F.col("src").alias("id")), 2).select("id")
    return e.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 1::BIGINT AS id, '000000001' AS path UNION ALL SELECT e.dst, t.path || '/' || lpad(e.dst::VARCHAR, 9, '0') FROM t JOIN e ON t.id = e.src) SELECT id, path FROM t")
def dfs_paths(spark, sf):
    """Each node's path from the root; in the order of paths, nodes stand as a depth-first walk meets them."""
    e = tree(spark, sf).select("src", F.col("dst").alias("id"))
    now = known = spark.range(1, 2).select("id", F.lit("000000001").alias("path"))
    while not now.isEmpty():
        now = now.select(F.col("id").alias("src"), "path").join(e, "src").select("id", F.concat("path", F.lit("/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("path"))
        now = graph._cut(now)
        known = known.union(now)
    return known


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 1::BIGINT AS id, 0 AS depth UNION ALL SELECT e.dst, t.depth + 1 FROM t JOIN e ON t.id = e.src) SELECT depth, COUNT(*) AS nodes, (SELECT COUNT(*) FROM e JOIN t u ON u.id = e.src WHERE u.depth = t.depth) AS links FROM t GROUP BY depth")
def fanout_by_level(spark, sf):
    """Nodes of each depth and the links that leave them."""
    e = tree(spark, sf)
    d = graph.bfs(e, spark.range(1, 2))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(out, "id", "left").groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


@query("SELECT link, COUNT(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY link")
def unique_links(spark, sf):
    """The distinct links of all pages, and how many pages have them."""
    p = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("link"))
    return p.distinct().groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


_BAGS = "b AS (SELECT o_custkey, list(struct_pack(k := o_orderkey, p := o_totalprice) ORDER BY o_orderkey) AS xs FROM orders GROUP BY o_custkey)"


@query(f"WITH {_BAGS} SELECT o_custkey, len(list_filter(xs, lambda x: x.p > 200000)) AS kept, list_sum(list_transform(xs, lambda x: x.k % 10))::BIGINT AS mapped FROM b")
def nested_filter_map(spark, sf):
    """Nested values filtered by a condition and mapped by an expression, inside the row."""
    b = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))).alias("xs"))
    return b.select("o_custkey", F.size(F.filter("xs", lambda x: x["p"] > 200000)).cast("long").alias("kept"), F.aggregate(F.transform("xs", lambda x: x["k"] % 10), F.lit(0).cast("long"), lambda s, x: s + x).alias("mapped"))


#: Edges that hold for a while: from src % 10 on, for six ticks.
_T = f"{_LINKS}, v AS (SELECT src, dst, src % 10 AS since, src % 10 + 6 AS until FROM l)"


def timed(spark, sf):
    return links(spark, sf).withColumns({"since": F.col("src") % 10, "until": F.col("src") % 10 + 6})


@query(f"WITH {_T} SELECT src, dst FROM v WHERE since <= 7 AND 7 < until")
def edges_at(spark, sf):
    return timed(spark, sf).where("since <= 7 AND 7 < until").select("src", "dst")


@query(f"WITH {_T} SELECT DISTINCT id FROM (SELECT src AS id FROM v WHERE since <= 7 AND 7 < until UNION SELECT dst FROM v WHERE since <= 7 AND 7 < until)")
def nodes_at(spark, sf):
    e = edges_at(spark, sf)
    return e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()


@query(f"WITH {_T} SELECT src, dst, since, until FROM v WHERE since < 9 AND until > 8 AND src % 50 < 25 AND dst % 50 < 25")
def edges_between(spark, sf):
    """Edges among some nodes whose time overlaps a span."""
    return timed(spark, sf).where("since < 9 AND until > 8 AND src % 50 < 25 AND dst % 50 < 25")


@query(f"WITH RECURSIVE {_T}, a AS (SELECT src, dst FROM v WHERE since <= 7 AND 7 < until), t AS (SELECT DISTINCT src AS id, 0 AS hops FROM a WHERE src % 5 = 3 UNION SELECT a.dst, t.hops + 1 FROM t JOIN a ON a.src = t.id WHERE t.hops < 12) SELECT id, MIN(hops) AS hops FROM t GROUP BY id")
def temporal_path(spark, sf):
    """How many edges that hold at a time lead to a node from some roots, within twelve."""
    a = edges_at(spark, sf)
    return graph.bfs(a, a.where("src % 5 = 3").select(F.col("src").alias("id")), 12).withColumnRenamed("depth", "hops")


@query("SELECT o_custkey AS node, o_orderkey AS version, o_orderstatus AS value, o_orderdate AS since, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders")
def node_history(spark, sf):
    """A node's values, each until the next."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("since"), F.lead("o_orderdate").over(w).alias("until"))


_VER = "v AS (SELECT o_custkey AS object, o_orderkey AS id, o_orderdate AS made, o_orderpriority AS tag, o_orderstatus AS branch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)"


def versions(spark, sf):
    w = W.partitionBy("object").orderBy("made", "id")
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("made"), F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("branch"))
    return v.withColumn("version", F.row_number().over(w).cast("long"))


_WHICH = {"latest": ("branch = 'O'", "max"), "at_version": ("version <= 3", "max"), "at_time": ("made <= TIMESTAMP '1998-01-01'", "max"), "tagged": ("tag = '1-URGENT'", "min"), "on_branch": ("branch = 'F'", "max")}


def _version(name, where, pick):
    def f(spark, sf):
        v = versions(spark, sf).where(where)
        return v.groupBy("object").agg({"max": F.max, "min": F.min}[pick](F.struct("version", "id")).alias("v")).select("object", "v.version", "v.id")

    f.__name__ = f"version_{name}"
    query(f"WITH {_VER} SELECT object, {pick}(version) AS version, arg_{pick}(id, version) AS id FROM v WHERE {where} GROUP BY object")(f)


for _n, (_w, _p) in _WHICH.items():
    _version(_n, _w, _p)


def _policy(name, sql):
    def f(spark, sf):
        a, b = _snapshots(spark, sf)
        if name == "union_all":
            return a.unionByName(b)
        mine, other = (a, b) if name in ("keep_mine", "ours") else (b, a)
        return mine.unionByName(other.join(mine.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "o_totalprice"))

    f.__name__ = f"merge_{name}"
    query(f"WITH {_SNAP} {sql}")(f)


for _n, _s in (("keep_mine", "SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)"), ("keep_other", "SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)"), ("union_all", "SELECT * FROM a UNION ALL SELECT * FROM b")):
    _policy(_n, _s)


@query(f"WITH {_SNAP} SELECT COUNT(*) FILTER (a.o_orderkey IS NULL) AS added, COUNT(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS skipped, COUNT(*) AS total FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def archive_merge(spark, sf):
    """What merging one archive into another adds and skips."""
    a, b = _snapshots(spark, sf)
    j = a.select("o_orderkey", F.lit(1).alias("x")).join(b.select("o_orderkey", F.lit(1).alias("y")), "o_orderkey", "full")
    return j.agg(F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("skipped"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {_SNAP}, u AS (SELECT o_orderkey, o_totalprice, 0 AS shard FROM a UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM b) SELECT o_orderkey, arg_max(shard, o_totalprice * 2 - shard) AS shard, MAX(o_totalprice) AS score, COUNT(DISTINCT o_totalprice) > 1 AS conflict FROM u GROUP BY o_orderkey")
def shard_merge(spark, sf):
    """Shards merged by the highest score, ties to the first shard, conflicts marked."""
    a, b = _snapshots(spark, sf)
    u = a.withColumn("shard", F.lit(0)).unionByName(b.withColumn("shard", F.lit(1)))
    g = u.groupBy("o_orderkey").agg(F.max(F.struct("o_totalprice", (-F.col("shard")).alias("back"))).alias("m"), (F.min("o_totalprice") < F.max("o_totalprice")).alias("conflict"))
    return g.select("o_orderkey", (-F.col("m.back")).alias("shard"), F.col("m.o_totalprice").alias("score"), "conflict")


@query("WITH a AS (SELECT vec_id AS name, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 0), b AS (SELECT vec_id AS name, CASE WHEN vec_id % 5 = 0 THEN embedding[1:32]::DOUBLE[] WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE * 1.5) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 11 <> 0) SELECT name, CASE WHEN a.v IS NULL THEN 'Added' WHEN b.v IS NULL THEN 'Removed' WHEN len(a.v) <> len(b.v) THEN 'Shape' WHEN a.v = b.v THEN 'Same' ELSE 'Value' END AS change, CASE WHEN len(a.v) = len(b.v) THEN round(list_distance(a.v, b.v), 6) END AS distance FROM a FULL JOIN b USING (name)")
def tensor_diff(spark, sf):
    """Named vectors before and after: added, removed, of another shape, of another value and by how much."""
    from ..functions import vectors as V

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), V.doubles(F.col("embedding")).alias("v"))
    new = F.when(F.col("name") % 5 == 0, F.slice("v", 1, 32)).when(F.col("name") % 3 == 0, F.transform("v", lambda x: x * 1.5)).otherwise(F.col("v"))
    a, b = e.where("name % 7 <> 0").select("name", F.col("v").alias("x")), e.where("name % 11 <> 0").select("name", new.alias("y"))
    same = F.size("x") == F.size("y")
    change = F.when(F.col("x").isNull(), "Added").when(F.col("y").isNull(), "Removed").when(~same, "Shape").when(F.col("x") == F.col("y"), "Same").otherwise("Value")
    return a.join(b, "name", "full").select("name", change.alias("change"), F.when(same & F.col("x").isNotNull() & F.col("y").isNotNull(), F.round(V.l2(F.col("x"), F.col("y")), 6)).alias("distance"))


@query("SELECT l_orderkey AS output, l_partkey AS source, round(l_quantity / SUM(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem WHERE l_orderkey % 100 = 0")
def attributions(spark, sf):
    """What each output rests on, and with what share."""
    x = table(spark, sf, "lineitem").where("l_orderkey % 100 = 0")
    return x.select(F.col("l_orderkey").alias("output"), F.col("l_partkey").alias("source"), F.round(F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey")), 6).alias("share"))


@query("SELECT l_partkey AS source, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def top_sources(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(20)


_FACTS = "f AS (SELECT user_id AS s, event_type AS p, CAST(json_extract(props, '$.k') AS BIGINT) AS o FROM events)"


def facts(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("s"), F.col("event_type").alias("p"), F.get_json_object("props", "$.k").cast("long").alias("o"))


@query(f"WITH {_FACTS} SELECT p, COUNT(*) AS facts, COUNT(DISTINCT s) AS subjects, COUNT(DISTINCT o) AS objects FROM f GROUP BY p")
def predicate_counts(spark, sf):
    return facts(spark, sf).groupBy("p").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


@query(f"WITH {_FACTS} SELECT DISTINCT s, p, o FROM f")
def distinct_facts(spark, sf):
    return facts(spark, sf).distinct()


@query(f"WITH {_FACTS} SELECT DISTINCT a.s, a.o AS x, b.o AS y FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'purchase' AND b.p = 'error' AND a.o = b.o")
def pattern_join(spark, sf):
    """An exact predicate, a shared variable in two places: (?s purchase ?x), (?s error ?x)."""
    f = facts(spark, sf)
    a, b = f.where("p = 'purchase'").select("s", F.col("o").alias("x")), f.where("p = 'error'").select("s", F.col("o").alias("y"))
    return a.join(b, "s").where("x = y").select("s", "x", "y").distinct()


@query(f"WITH {_FACTS} SELECT DISTINCT s FROM f WHERE p LIKE '%i%' AND o IS NOT NULL AND o BETWEEN 90 AND 99")
def pattern_wildcard(spark, sf):
    """A wildcard in the predicate, and an object of a type and range."""
    return facts(spark, sf).where("p LIKE '%i%' AND o IS NOT NULL AND o BETWEEN 90 AND 99").select("s").distinct()


@query(f"WITH {_FACTS} SELECT DISTINCT s FROM f EXCEPT SELECT s FROM f WHERE p = 'purchase' AND o > 95")
def bool_not(spark, sf):
    f = facts(spark, sf)
    return f.select("s").subtract(f.where("p = 'purchase' AND o > 95").select("s"))


_RULES = "r AS (SELECT s_suppkey AS rule, s_nationkey AS head, s_suppkey % 3 + 1 AS arity, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 END AS arg FROM supplier)"


@query(f"WITH {_RULES} SELECT a.rule AS a, b.rule AS b FROM r a JOIN r b ON a.head = b.head AND a.arity = b.arity AND a.rule < b.rule AND (a.arg IS NULL OR b.arg IS NULL OR a.arg = b.arg)")
def head_overlaps(spark, sf):
    """Rules whose heads unify: the same name and arity, and arguments that are equal or variables (null)."""
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(k.alias("rule"), F.col("s_nationkey").alias("head"), (k % 3 + 1).alias("arity"), F.when(k % 4 != 0, k % 5).alias("arg"))
    a, b = (r.select("head", "arity", F.col("rule").alias(x), F.col("arg").alias(f"arg_{x}")) for x in "ab")
    return a.join(b, ["head", "arity"]).where("a < b AND (arg_a IS NULL OR arg_b IS NULL OR arg_a = arg_b)").select("a", "b")


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT src, dst, 1 AS steps, src || '>' || dst AS proof FROM e UNION ALL SELECT t.src, e.dst, t.steps + 1, t.proof || '>' || e.dst FROM t JOIN e ON t.dst = e.src) SELECT src, dst, steps, proof FROM t")
def proofs(spark, sf):
    """Every fact that the rule of ancestors gives, with its derivation."""
    e = tree(spark, sf)
    now = known = graph._cut(e.select("src", "dst", F.lit(1).alias("steps"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("proof")))
    step = e.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    while not now.isEmpty():
        now = graph._cut(now.join(step, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst"), (F.col("steps") + 1).alias("steps"), F.concat_ws(">", "proof", F.col("to").cast("string")).alias("proof")))
        known = known.union(now)
    return known


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT src, dst, 1 AS steps FROM e UNION ALL SELECT t.src, e.dst, t.steps + 1 FROM t JOIN e ON t.dst = e.src) SELECT src, dst, true AS valid FROM t")
def verified_proofs(spark, sf):
    """Each derivation checked step by step against the facts."""
    p = proofs(spark, sf).select("src", "dst", F.transform(F.split("proof", ">"), lambda x: x.cast("long")).alias("path"))
    steps = p.select("src", "dst", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("s"))
    bad = steps.select("src", "dst", "s.a", "s.b").join(tree(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti").select("src", "dst").distinct().withColumn("bad", F.lit(True))
    return p.select("src", "dst").join(bad, ["src", "dst"], "left").select("src", "dst", F.col("bad").isNull().alias("valid"))


_NAMES = "n AS (SELECT n_nationkey::BIGINT AS entity, n_name AS name, true AS canonical FROM nation UNION ALL SELECT n_nationkey, 'N' || split_part(n_name, '_', 2), false FROM nation), m AS (SELECT s_suppkey AS mention_id, CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'N' || s_nationkey WHEN 2 THEN 'NATIOM_' || s_nationkey ELSE 'somewhere' END AS text FROM supplier)"


@query(f"""WITH {_NAMES}, x AS (SELECT mention_id, arg_max(entity, (CASE WHEN canonical THEN 1000000 ELSE 0 END) - entity) AS entity, CASE WHEN bool_or(canonical) THEN 'exact' ELSE 'alias' END AS how FROM m JOIN n ON text = name GROUP BY mention_id),
z AS (SELECT mention_id, entity, 1 - levenshtein(text, name) / greatest(length(text), length(name))::DOUBLE AS sim FROM m JOIN n ON canonical AND text[1] = name[1] WHERE mention_id NOT IN (SELECT mention_id FROM x)), y AS (SELECT mention_id, arg_max(entity, sim - entity * 1e-6) AS entity, 'fuzzy' AS how FROM z WHERE sim >= 0.75 GROUP BY mention_id)
SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT mention_id, NULL, 'unresolved' FROM m WHERE mention_id NOT IN (SELECT mention_id FROM x) AND mention_id NOT IN (SELECT mention_id FROM y)""")
def entity_resolution(spark, sf):
    """Mentions by name, by alias, by edits within the first letter's block, or not."""
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_name").alias("name"), F.lit(True).alias("canonical"))
    names = names.unionByName(n.select(F.col("n_nationkey").cast("long").alias("entity"), F.concat(F.lit("N"), F.split_part("n_name", F.lit("_"), F.lit(2))).alias("name"), F.lit(False).alias("canonical")))
    k, at = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("NATION_"), at)).when(k == 1, F.concat(F.lit("N"), at)).when(k == 2, F.concat(F.lit("NATIOM_"), at)).otherwise("somewhere")
    return L.resolve(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mention_id"), text.alias("text")), names, 0.75, X.edit_similarity)


@query(f"WITH {_NAMES} SELECT name AS alias, entity FROM n WHERE NOT canonical")
def entity_aliases(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("N"), F.split_part("n_name", F.lit("_"), F.lit(2))).alias("alias"), F.col("n_nationkey").cast("long").alias("entity"))


_SPANS = "i AS (SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) * 10 AS e FROM events)"


def spans(spark, sf):
    """(id, user_id, s, e): each event lasts ten times its value in minutes."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", micros("ts").alias("s"), (micros("ts") + F.round(F.col("value") * 60000000).cast("long") * 10).alias("e"))


@query(f"WITH {_SPANS}, w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM i), c AS (SELECT *, SUM(CASE WHEN so_far IS NULL OR s > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, id) AS chain FROM w) SELECT user_id, chain::BIGINT AS chain, COUNT(*) AS n, MIN(s) AS s, MAX(e) AS e FROM c GROUP BY 1, 2")
def event_chains(spark, sf):
    """Spans of a user that touch or overlap, one after the other, as chains."""
    w = W.partitionBy("user_id").orderBy("s", "id")
    i = spans(spark, sf).withColumn("so_far", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
    c = i.withColumn("chain", F.sum((F.col("so_far").isNull() | (F.col("s") > F.col("so_far"))).cast("int")).over(w))
    return c.groupBy("user_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))


@query(f"WITH {_SPANS} SELECT a.id, COUNT(b.id) AS others FROM i a LEFT JOIN i b ON a.user_id = b.user_id AND a.id <> b.id AND a.s <= b.e AND b.s <= a.e GROUP BY a.id")
def concurrent_events(spark, sf):
    """How many other spans of its user each span meets, from running counts of starts and ends."""
    return temporal.overlap_counts(spans(spark, sf), "user_id").select("id", "others")


@query(f"WITH {_SPANS} SELECT id, s, e - s AS duration FROM i WHERE user_id = 8 ORDER BY s, id")
def timeline(spark, sf):
    return spans(spark, sf).where("user_id = 8").orderBy("s", "id").select("id", "s", (F.col("e") - F.col("s")).alias("duration"))


_KINDS = ["before", "after", "overlapping", "during", "within"]


@query(f"WITH {_SPANS}, c AS (SELECT event_id AS id, [{', '.join(repr(k) for k in _KINDS)}][event_id % 5 + 1] AS kind, event_id AS a, event_id * 3 + 1 AS b FROM events), j AS (SELECT c.id, kind, x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye FROM c JOIN i x ON x.id = c.a JOIN i y ON y.id = c.b) SELECT id, kind FROM j WHERE NOT CASE kind WHEN 'before' THEN xe < ys WHEN 'after' THEN xs > ye WHEN 'overlapping' THEN xs <= ye AND ys <= xe WHEN 'during' THEN xs >= ys AND xe <= ye ELSE abs(ys - xs) <= 86400000000 END")
def constraint_violations(spark, sf):
    """Constraints between events that don't hold; one whose event is missing isn't broken."""
    k = F.col("event_id")
    c = table(spark, sf, "events").select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 5 + 1).cast("int")).alias("kind"), k.alias("a"), (k * 3 + 1).alias("b"))
    return L.violated(c, spans(spark, sf), 86_400_000_000)


@query("WITH o AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS t FROM events), g AS (SELECT user_id, event_type, r - t AS run, COUNT(*) AS n, MIN(r) AS first_r, MAX(r) AS last_r, MIN(ts) AS began, arg_min(event_id, r) AS first_id FROM o GROUP BY 1, 2, 3) SELECT g.user_id, g.first_id, g.n AS views, x.event_id AS then_id FROM g JOIN o x ON x.user_id = g.user_id AND x.r = g.last_r + 1 WHERE g.event_type = 'view' AND g.n BETWEEN 2 AND 4 AND x.event_type = 'purchase' AND epoch_us(x.ts) - epoch_us(began) <= 864000000000")
def seq_repeat(spark, sf):
    """A run of two to four views and then a purchase, within ten days from end to end."""
    return temporal.run_then(table(spark, sf, "events"), "view", "purchase", 2, 4, 864_000)


@query("WITH o AS (SELECT user_id, event_id, event_type, ts, lead(event_type) OVER w AS nxt, lead(event_id) OVER w AS then_id, lead(ts) OVER w AS nts FROM events WHERE event_type IN ('view', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id AS first_id, then_id FROM o WHERE event_type = 'view' AND nxt = 'purchase' AND epoch_us(nts) - epoch_us(ts) BETWEEN 600000000 AND 172800000000")
def seq_without(spark, sf):
    """A view and then a purchase, with no error or other view between, ten minutes to two days later; others may lie between."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'purchase', 'error')")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    o = e.select("user_id", F.col("event_id").alias("first_id"), "event_type", F.lead("event_type").over(w).alias("nxt"), F.lead("event_id").over(w).alias("then_id"), (micros(F.lead("ts").over(w)) - micros("ts")).alias("gap"))
    return o.where("event_type = 'view' AND nxt = 'purchase' AND gap BETWEEN 600000000 AND 172800000000").select("user_id", "first_id", "then_id")


@query("WITH o AS (SELECT user_id, event_type || '>' || lead(event_type) OVER w AS step, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT step, CASE WHEN gap = 0 THEN 'simultaneous' WHEN gap <= 3600000000 THEN 'within' WHEN gap <= 86400000000 THEN 'between' ELSE 'after' END AS gap, COUNT(*) AS n FROM o WHERE step IS NOT NULL GROUP BY 1, 2")
def seq_gaps(spark, sf):
    """Steps from an event to the user's next one, by how far apart."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf, "events").select(F.concat("event_type", F.lit(">"), F.lead("event_type").over(w)).alias("step"), (micros(F.lead("ts").over(w)) - micros("ts")).alias("us")).where("step IS NOT NULL")
    gap = L.first_match([("simultaneous", F.col("us") == 0), ("within", F.col("us") <= 3_600_000_000), ("between", F.col("us") <= 86_400_000_000)], "after")
    return o.groupBy("step", gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT a.dst AS x, b.dst AS y FROM e a JOIN e b ON a.src = b.src WHERE a.dst <> b.dst UNION SELECT a.dst, b.dst FROM t JOIN e a ON a.src = t.x JOIN e b ON b.src = t.y) SELECT x, y FROM t WHERE x < 64 AND y < 64")
def same_generation(spark, sf):
    """Two rules: siblings are of one generation, and so are children of those that are."""
    e = tree(spark, sf).where("dst < 64")
    a, b = e.select(F.col("src").alias("px"), F.col("dst").alias("x2")), e.select(F.col("src").alias("py"), F.col("dst").alias("y2"))
    base = a.join(b, F.col("px") == F.col("py")).where("x2 <> y2").select(F.col("x2").alias("x"), F.col("y2").alias("y"))
    step = lambda new: new.join(a, new["x"] == a["px"]).join(b, F.col("y") == F.col("py")).select(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return graph.fixpoint(base, step)
