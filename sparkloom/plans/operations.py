"""Lookups, filters by tags and rules, audits, usage, forecasts, alerts and access patterns."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import blocks
from ..operators import rules as L
from ..operators.temporal import micros
from ..sources.tables import table


@query("SELECT doc_id, sha256(text) AS cid, n_chars FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 100 = 0)")
def block_lookup(spark, sf):
    """Blocks by content id: of every hundredth document all that have the same content."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("cid"), "n_chars")
    return d.join(d.where("doc_id % 100 = 0").select("cid"), "cid", "left_semi").select("doc_id", "cid", "n_chars")


@query("SELECT event_id, ts, event_type FROM events WHERE event_id = 42")
def event_lookup(spark, sf):
    return table(spark, sf, "events").where("event_id = 42").select("event_id", "ts", "event_type")


_TAGGED = "t AS (SELECT p_partkey, p_size, p_brand, p_retailprice, list_concat(string_split(p_name, ' '), [lower(p_type)]) AS tags FROM part)"


def tagged(spark, sf):
    return table(spark, sf, "part").withColumn("tags", F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))


@query(f"WITH {_TAGGED} SELECT p_partkey, p_size FROM t WHERE p_brand <> 'Brand#17' AND p_size BETWEEN 5 AND 40 AND p_retailprice > 905 AND list_contains(tags, 'economy') ORDER BY p_retailprice DESC, p_partkey")
def index_query(spark, sf):
    """Type, inclusive sizes, strictly after a time, a tag; newest first."""
    c = (F.col("p_brand") != "Brand#17") & F.col("p_size").between(5, 40) & (F.col("p_retailprice") > 905) & F.array_contains("tags", "economy")
    return tagged(spark, sf).where(c).orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_size")


@query(f"WITH {_TAGGED} SELECT tag, COUNT(*) AS parts, MIN(p_partkey) AS first FROM (SELECT p_partkey, unnest(tags) AS tag FROM t) GROUP BY tag")
def tag_index(spark, sf):
    return tagged(spark, sf).select("p_partkey", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first"))


@query(f"WITH {_TAGGED} SELECT p_partkey FROM t WHERE list_contains(tags, 'red')")
def find_by_tag(spark, sf):
    return tagged(spark, sf).where(F.array_contains("tags", "red")).select("p_partkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 7")
def events_with_tag(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("int") == 7).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R' AND l_linestatus = 'O'")
def manifest_filter(spark, sf):
    """Entries by size, codec and whether they are pinned."""
    return table(spark, sf, "lineitem").where("l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R' AND l_linestatus = 'O'").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, ts FROM events WHERE event_type IN ('click', 'view') AND user_id BETWEEN 3 AND 30 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 40 OFFSET 20")
def event_page(spark, sf):
    """Events by types, users and time, a page of them: a sort that keeps 60 rows a task."""
    e = table(spark, sf, "events").where("event_type IN ('click', 'view') AND user_id BETWEEN 3 AND 30 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
    return e.orderBy("ts", "event_id").offset(20).limit(40).select("event_id", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_events(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id = 8 AND ts < TIMESTAMP '2024-01-25'")
def audit_query(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error' AND user_id = 8 AND ts < TIMESTAMP '2024-01-25'").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 15")
def recent_failures(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id", "user_id")


_NOW = "TIMESTAMP '2002-01-01'"


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 12 AS hits, o_orderpriority AS tag, date_diff('day', o_orderdate, {_NOW}) AS age FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'keep: pinned' WHEN tag = '1-URGENT' THEN 'keep: tag' WHEN tag = '5-LOW' AND age > 365 THEN 'expire: tag' WHEN age > 2000 THEN 'expire: age' WHEN hits < 2 THEN 'expire: unused' WHEN o_totalprice > 400000 THEN 'expire: size' ELSE 'keep' END AS decision FROM r""")
def retention_rules(spark, sf):
    """Pinned, tags that keep or don't, age, accesses and size: the first that holds decides."""
    age = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    tag, hits = F.col("o_orderpriority"), F.col("o_orderkey") % 12
    rules = [("keep: pinned", F.col("o_orderstatus") == "P"), ("keep: tag", tag == "1-URGENT"), ("expire: tag", (tag == "5-LOW") & (age > 365)), ("expire: age", age > 2000), ("expire: unused", hits < 2), ("expire: size", F.col("o_totalprice") > 400000)]
    return table(spark, sf, "orders").select("o_orderkey", L.first_match(rules, "keep").alias("decision"))


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 12 AS hits, date_diff('day', o_orderdate, {_NOW}) AS age FROM orders), m AS (SELECT o_orderkey, CASE WHEN age > 1500 AND hits < 4 THEN 'archive' WHEN o_totalprice > 300000 OR o_orderstatus = 'F' THEN 'move to warm' WHEN (o_orderkey * 7) % 90 > 60 THEN 'move to cold' END AS action FROM r)
SELECT o_orderkey, action FROM m WHERE action IS NOT NULL ORDER BY o_orderkey LIMIT 200""")
def lifecycle_actions(spark, sf):
    """The first rule of age, access, size and tier that holds for each row; at most 200 actions at a time, which is the feature."""
    age, hits = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")), F.col("o_orderkey") % 12
    rules = [("archive", (age > 1500) & (hits < 4)), ("move to warm", (F.col("o_totalprice") > 300000) | (F.col("o_orderstatus") == "F")), ("move to cold", (F.col("o_orderkey") * 7) % 90 > 60)]
    m = table(spark, sf, "orders").select("o_orderkey", L.first_match(rules, "").alias("action"))
    return m.where("action <> ''").orderBy("o_orderkey").limit(200)


@query("WITH r AS (SELECT user_id, COUNT(*) / 30.0::DOUBLE AS rate FROM events GROUP BY user_id) SELECT user_id, round(rate, 6) AS rate, CASE WHEN rate >= 3 THEN 'hot' WHEN rate >= 2 THEN 'warm' WHEN rate >= 1 THEN 'cold' ELSE 'archive' END AS tier FROM r")
def tier_by_rate(spark, sf):
    rate = F.count(F.lit(1)) / 30.0
    r = table(spark, sf, "events").groupBy("user_id").agg(rate.alias("rate"))
    tier = L.first_match([("hot", F.col("rate") >= 3), ("warm", F.col("rate") >= 2), ("cold", F.col("rate") >= 1)], "archive")
    return r.select("user_id", F.round("rate", 6).alias("rate"), tier.alias("tier"))


@query("SELECT least(CAST(floor(log2(greatest(n_chars, 1))) AS BIGINT), 20) AS size_bucket, doc_id // 100 AS tick_bucket, COUNT(*) AS n, MIN(doc_id) AS first FROM documents GROUP BY 1, 2")
def metadata_buckets(spark, sf):
    """Documents by the logarithm of their size and by blocks of ids."""
    size = F.least(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)))), F.lit(20)).cast("long")
    return table(spark, sf, "documents").groupBy(size.alias("size_bucket"), F.floor(F.col("doc_id") / 100).alias("tick_bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT user_id, event_type, round(AVG(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING AVG(value) > 40")
def slow_rules(spark, sf):
    """Kinds of work whose mean time is over a threshold."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean")).where("mean > 40").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, COUNT(*) FILTER (event_type = 'click') AS click, COUNT(*) FILTER (event_type = 'view') AS \"view\", COUNT(*) FILTER (event_type = 'error') AS error, round(COUNT(*) FILTER (event_type = 'purchase') / COUNT(*)::DOUBLE, 6) AS match_rate, epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS span FROM events GROUP BY user_id")
def session_summary(spark, sf):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy("user_id").agg(kind("click").alias("click"), kind("view").alias("view"), kind("error").alias("error"), F.round(kind("purchase") / F.count(F.lit(1)), 6).alias("match_rate"), (micros(F.max("ts")) - micros(F.min("ts"))).alias("span"))


@query("WITH d AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS d, SUM(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT user_id, d, SUM(v) OVER (PARTITION BY user_id ORDER BY d) AS used FROM d), f AS (SELECT user_id, regr_slope(used, d) AS slope, MAX(used) AS used FROM c GROUP BY user_id HAVING COUNT(*) >= 2) SELECT user_id, round(slope, 4) AS per_day, round(used + 30 * slope, 3) AS in_30_days, CASE WHEN slope > 0 AND used < 5000 THEN CAST(floor(round((5000 - used) / slope, 6)) AS BIGINT) END AS days_left FROM f")
def usage_forecast(spark, sf):
    """Least squares over each user's running use: a day's growth, use in 30 days and days until a quota."""
    d = table(spark, sf, "events").groupBy("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d")).agg(F.sum("value").alias("v"))
    c = d.withColumn("used", F.sum("v").over(W.partitionBy("user_id").orderBy("d")))
    f = c.groupBy("user_id").agg(F.regr_slope("used", F.col("d").cast("double")).alias("slope"), F.max("used").alias("used"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    left = F.when((F.col("slope") > 0) & (F.col("used") < 5000), F.floor(F.round((5000 - F.col("used")) / F.col("slope"), 6)).cast("long"))
    return f.select("user_id", F.round("slope", 4).alias("per_day"), F.round(F.col("used") + 30 * F.col("slope"), 3).alias("in_30_days"), left.alias("days_left"))


@query("SELECT user_id, round(SUM(value) / 86400.0::DOUBLE, 8) AS rate FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id ORDER BY round(SUM(value) / 86400.0::DOUBLE, 8) DESC, user_id LIMIT 10")
def top_senders(spark, sf):
    """The ten users with the highest rate in the last day."""
    e = table(spark, sf, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    r = e.join(F.broadcast(last)).where("ts >= since").groupBy("user_id").agg(F.round(F.sum("value") / 86400.0, 8).alias("rate"))
    return r.orderBy(F.desc("rate"), "user_id").limit(10)


@query("SELECT c_nationkey AS region, COUNT(*) AS hits FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING COUNT(*) >= 50")
def region_hotspots(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("hits")).where("hits >= 50")


_LAST = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"


@query(f"""WITH {_LAST}, ten AS (SELECT user_id, COUNT(*) FILTER (event_type = 'purchase') AS writes, max(r) AS n FROM r WHERE r <= 10 GROUP BY user_id), top AS (SELECT user_id, MAX(c) AS same FROM (SELECT user_id, event_type, COUNT(*) AS c FROM r WHERE r <= 10 GROUP BY 1, 2) GROUP BY user_id),
five AS (SELECT user_id, bool_and(value < before) AS rising, COUNT(*) AS k FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY r) AS before FROM r WHERE r <= 5) WHERE before IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN writes >= 5 THEN 'BurstWrite' WHEN same >= 5 THEN 'Repeated' WHEN k = 4 AND rising THEN 'Sequential' ELSE 'Random' END AS pattern FROM ten JOIN top USING (user_id) LEFT JOIN five USING (user_id)""")
def access_patterns(spark, sf):
    """What a user's last ten accesses look like, by priority: many writes, one kind over and over, values that only rise, none."""
    back = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").withColumn("r", F.row_number().over(back)).where("r <= 10").withColumn("before", F.lag("value").over(back))
    ten = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("r").between(2, 5) & (F.col("value") < F.col("before"))).cast("int")).alias("up"), F.count_if(F.col("r").between(2, 5)).alias("k"))
    u = ten.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("c")).otherwise(0)).alias("writes"), F.max("c").alias("same"), F.sum("up").alias("up"), F.sum("k").alias("k"))
    p = L.first_match([("BurstWrite", F.col("writes") >= 5), ("Repeated", F.col("same") >= 5), ("Sequential", (F.col("k") == 4) & (F.col("up") == 4))], "Random")
    return u.select("user_id", p.alias("pattern"))


def _trailing(name, sql, micro):
    def f(spark, sf):
        e = table(spark, sf, "events")
        last = e.agg(F.max("ts").alias("end"))
        x = e.join(F.broadcast(last)).where(micros("end") - micros("ts") <= micro)
        v = F.col("value")
        m = x.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("dev"), F.round(F.regr_slope(v, micros("ts") / 1e6), 9).alias("trend"))
        q = blocks.quantiles(x, [], "value", "event_id", (0.5, 0.95, 0.99))
        return m.join(q.select(*[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))]))

    f.__name__ = name
    query(f"WITH x AS (SELECT value, ts FROM events WHERE epoch_us((SELECT MAX(ts) FROM events)) - epoch_us(ts) <= {micro}) SELECT COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi, round(AVG(value), 6) AS mean, round(stddev_pop(value), 6) AS dev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, CASE WHEN COUNT(*) > 1 THEN round(regr_slope(value, epoch_us(ts) / 1e6), 9) END AS trend FROM x")(f)


for _name, _us in (("trailing_hour", 3_600_000_000), ("trailing_day", 86_400_000_000), ("trailing_week", 604_800_000_000)):
    _trailing(_name, None, _us)


@query("SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS n, round(AVG(value), 6) AS mean, CASE WHEN AVG(value) > 35 THEN 'critical' WHEN AVG(value) > 25 THEN 'warning' END AS alert FROM events GROUP BY 1 HAVING AVG(value) > 25")
def metric_alerts(spark, sf):
    """Hours whose mean is over a threshold, and which."""
    h = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).where("m > 25")
    return h.select(F.col("w.start").alias("hour"), "n", F.round("m", 6).alias("mean"), F.when(F.col("m") > 35, "critical").otherwise("warning").alias("alert"))


@query("WITH m AS (SELECT MAX(ts) AS now FROM events) SELECT user_id, COUNT(*) AS n, round(SUM(exp(-(epoch_us(now) - epoch_us(ts)) / 86400000000.0::DOUBLE / 7)), 6) AS heat, MAX(ts) AS last FROM events, m GROUP BY user_id ORDER BY round(SUM(exp(-(epoch_us(now) - epoch_us(ts)) / 86400000000.0::DOUBLE / 7)), 6) DESC, user_id LIMIT 20")
def access_heat(spark, sf):
    """The twenty users of most recent use: each access counts less the older it is."""
    e = table(spark, sf, "events")
    x = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    heat = F.round(F.sum(F.exp(-(micros("now") - micros("ts")) / 86400000000.0 / 7)), 6)
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), heat.alias("heat"), F.max("ts").alias("last")).orderBy(F.desc("heat"), "user_id").limit(20)


@query("SELECT l_returnflag AS tier, round(SUM(l_quantity) * 0.02, 4) AS storage, round(COUNT(*) * 0.0004::DOUBLE, 6) AS requests, round(SUM(l_extendedprice) * 1e-6, 6) AS transfer, round(SUM(l_quantity) * 0.02 + COUNT(*) * 0.0004 + SUM(l_extendedprice) * 1e-6, 4) AS total FROM lineitem GROUP BY 1")
def cost_breakdown(spark, sf):
    q, n, x = F.sum("l_quantity") * 0.02, F.count(F.lit(1)) * 0.0004, F.sum("l_extendedprice") * 1e-6
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tier")).agg(F.round(q, 4).alias("storage"), F.round(n, 6).alias("requests"), F.round(x, 6).alias("transfer"), F.round(q + n + x, 4).alias("total"))


@query("WITH o AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '|3'), 1, 13))::BIGINT AS u FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY u, doc_id) - 1 AS place FROM o) SELECT doc_id, place // 32 AS batch, place % 32 AS slot FROM r WHERE place // 32 < (SELECT COUNT(*) // 32 FROM documents)")
def training_batches(spark, sf):
    """Mini-batches of 32 in a seeded order, without the last part-filled one: places come from a range partitioning's counts."""
    u = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|3")).cast("binary")), 1, 13), 16, 10).cast("long")
    d = table(spark, sf, "documents").select("doc_id", u.alias("u"))
    n = d.count()
    parts = max(1, n // 100_000)
    dealt = d.withColumn("part", F.floor(F.col("u") / (F.lit(16**13) / parts)).cast("int"))
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("u", "doc_id")) - 1 + F.col("before")
    r = dealt.join(F.broadcast(before), "part").withColumn("place", place.cast("long"))
    return r.where(F.floor(F.col("place") / 32) < n // 32).select("doc_id", F.floor(F.col("place") / 32).alias("batch"), (F.col("place") % 32).alias("slot"))
