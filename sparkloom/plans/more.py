"""Blocks, access patterns, text similarity, vectors, statistics, merges and streams."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..functions import vectors as V
from ..operators import diff, stats, temporal
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming import patterns, windows
from .analytics import _SNAP, _snapshots
from .search import _C, centroids


@query("SELECT CASE WHEN n_chars <= 1024 THEN '1K' WHEN n_chars <= 10240 THEN '10K' WHEN n_chars <= 102400 THEN '100K' WHEN n_chars <= 1048576 THEN '1M' ELSE 'more' END AS size_class, COUNT(*) AS n FROM documents GROUP BY 1")
def block_distribution(spark, sf):
    n = F.col("n_chars")
    size = F.when(n <= 1024, "1K").when(n <= 10240, "10K").when(n <= 102400, "100K").when(n <= 1048576, "1M").otherwise("more")
    return table(spark, sf, "documents").groupBy(size.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def largest_blocks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def orphaned_blocks(spark, sf):
    c = table(spark, sf, "customer")
    free = c.join(table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return free.join(table(spark, sf, "supplier").where("s_acctbal > 8000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("SELECT sha256(text) AS cid, (COUNT(*) - 1) * MIN(length(text)) AS saved FROM documents GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY saved DESC, cid LIMIT 20")
def dedup_savings(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("cid"), F.char_length("text").cast("long").alias("n"))
    g = d.groupBy("cid").agg(F.count(F.lit(1)).alias("refs"), F.min("n").alias("n")).where("refs > 1")
    return g.select("cid", ((F.col("refs") - 1) * F.col("n")).alias("saved")).orderBy(F.desc("saved"), "cid").limit(20)


@query("SELECT user_id, event_id, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi, COUNT(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def window_last_10(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT user_id, MAX(epoch_us(ts)) + (MAX(epoch_us(ts)) - MIN(epoch_us(ts))) // (COUNT(*) - 1) AS next_us FROM events GROUP BY user_id HAVING COUNT(*) > 1")
def predict_next_access(spark, sf):
    us = temporal.micros("ts")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.max(us).alias("hi"), F.min(us).alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select("user_id", F.expr("hi + (hi - lo) div (n - 1)").alias("next_us"))


@query("SELECT a, b, COUNT(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b")
def co_access(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return p.where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, COUNT(*) FILTER (event_type = 'view') AS view, COUNT(*) FILTER (event_type = 'click') AS click, COUNT(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def trace_summary(spark, sf):
    kinds = ["view", "click", "purchase"]
    return table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


@query("SELECT date_trunc('hour', ts) AS hour, round(SUM(value) / 3600.0::DOUBLE, 6) AS per_second FROM events GROUP BY 1")
def throughput(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.sum("value") / 3600.0, 6).alias("per_second"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem GROUP BY 1")
def linear_trend(spark, sf):
    t = stats.linear_trend(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity"))
    return t.select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("r2", 5).alias("r2"))


@query("SELECT f, round(m, 4) AS mean, round(m - 1.96::DOUBLE * s / sqrt(n), 4) AS lo, round(m + 1.96::DOUBLE * s / sqrt(n), 4) AS hi FROM (SELECT l_linestatus AS f, AVG(l_quantity) AS m, stddev_samp(l_quantity) AS s, COUNT(*) AS n FROM lineitem GROUP BY 1)")
def confidence_interval(spark, sf):
    c = stats.confidence(table(spark, sf, "lineitem"), ["l_linestatus"], F.col("l_quantity"))
    return c.select(F.col("l_linestatus").alias("f"), *[F.round(x, 4).alias(x) for x in ("mean", "lo", "hi")])


@query("SELECT p_partkey, round(1 - levenshtein(lower(p_brand), lower(p_type)) / greatest(length(p_brand), length(p_type))::DOUBLE, 6) AS sim FROM part")
def edit_similarity(spark, sf):
    d = F.levenshtein(F.lower("p_brand"), F.lower("p_type")) / F.greatest(F.char_length("p_brand"), F.char_length("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.round(1 - d, 6).alias("sim"))


@query("SELECT word, COUNT(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS word FROM documents) GROUP BY 1 HAVING COUNT(*) >= 20")
def vocabulary(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"), [])).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("SELECT stem, COUNT(*) AS n FROM (SELECT regexp_replace(w, '^(..+)(tion|ness|ment|ing|ed|ly)$', '\\1') AS stem FROM (SELECT unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM documents WHERE lang = 'en')) GROUP BY stem HAVING COUNT(*) >= 20")
def stems(spark, sf):
    w = table(spark, sf, "documents").where("lang = 'en'").select(F.explode(T.tokens(F.col("text"), [])).alias("w"))
    return w.groupBy(F.regexp_replace("w", "^(..+)(tion|ness|ment|ing|ed|ly)$", "$1").alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("SELECT doc_id, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS unit FROM (SELECT vec_id AS doc_id, list_transform(v, lambda x: x / n) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))")
def normalised_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("v")).withColumn("n", V.norm(F.col("v")))
    u = F.transform("v", lambda x: x / F.col("n"))
    return e.select("doc_id", F.round(V.dot(u, u), 4).alias("unit"))


def _elementwise(how, sql):
    def f(spark, sf):
        x = stats.elementwise(table(spark, sf, "embeddings"), "label", "embedding", how)
        return x.select("label", F.col("i").cast("long").alias("i"), F.round("x", 4).alias("x"))

    f.__name__ = f"vector_agg_{how}"
    query(f"SELECT label, i, round({sql}(x), 4) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i")(f)


for _how, _sql in (("mean", "AVG"), ("sum", "SUM"), ("max", "MAX"), ("min", "MIN")):
    _elementwise(_how, _sql)


@query(f"WITH {_C}, s AS (SELECT vec_id, c.label AS route, round(list_cosine_similarity(c, embedding::DOUBLE[]), 6) AS score FROM c, embeddings) SELECT vec_id, CASE WHEN score >= 0.3 THEN route ELSE -1 END AS route, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s.route) = 1")
def nearest_route(spark, sf):
    """The routes are one array of a struct a label; the best of them is found inside each vector's row."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    routes = centroids(table(spark, sf, "embeddings")).agg(F.collect_list(F.struct("label", "c")).alias("routes"))
    scored = F.transform("routes", lambda r: F.struct(F.round(V.cosine(r["c"], F.col("embedding")), 6).alias("score"), (-r["label"]).alias("back")))
    best = e.join(F.broadcast(routes)).select("vec_id", F.array_max(scored).alias("b"))
    return best.select("vec_id", F.when(F.col("b.score") >= 0.3, -F.col("b.back")).otherwise(-1).alias("route"), F.col("b.score").alias("score"))


@query(f"WITH {_SNAP} SELECT * FROM b")
def apply_patch(spark, sf):
    a, b = _snapshots(spark, sf)
    return diff.apply_patch(a, b, diff.snapshot_diff(a, b, "o_orderkey", "o_totalprice"), "o_orderkey")


@query("WITH j AS (SELECT o_orderkey, o_totalprice AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS t FROM orders), k AS (SELECT *, o IS DISTINCT FROM t AND o IS DISTINCT FROM b AND t IS DISTINCT FROM b AS conflict FROM j) SELECT o_orderkey, CASE WHEN conflict THEN COALESCE(o, t) WHEN o IS NOT DISTINCT FROM b THEN t ELSE o END AS o_totalprice, conflict FROM k WHERE CASE WHEN conflict THEN COALESCE(o, t) WHEN o IS NOT DISTINCT FROM b THEN t ELSE o END IS NOT NULL")
def three_way_merge(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    ours = base.where(k % 5 != 0).withColumn("o_totalprice", F.when(k % 3 == 0, p + 1).otherwise(p))
    theirs = base.withColumn("o_totalprice", F.when(k % 7 == 0, p + 2).otherwise(p))
    return diff.three_way(base, ours, theirs, "o_orderkey", "o_totalprice")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf):
    path = f"{sf}/events.parquet"
    # The stream source takes a single file only by a pattern; this one fits a folder of files as well.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/event[s].parquet")
    got = windows.run_to_end(windows.hourly(events), ["hour", "event_type"], new_path(spark, "stream"))
    return got.withColumn("hour", F.col("hour").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, first_id, then_id FROM (SELECT user_id, event_id AS first_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_id) OVER w AS then_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a = 'view' AND b = 'purchase' AND gap <= 86400000000")
def stream_patterns(spark, sf):
    """A view and then a purchase within a day, over a stream with state."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/event[s].parquet")
    return patterns.run_appended(patterns.follow(events, "view", "purchase", 86_400), new_path(spark, "patterns"))
