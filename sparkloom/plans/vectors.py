"""Normalising, quantising, reducing, composing, judging and clustering vectors; privacy; tests and features."""

import numpy as np
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..operators import search as S
from ..operators import vectorial as O
from ..sources.tables import table
from .search import _C

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def add(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@query(f"WITH {_E}, n AS (SELECT *, list_sum(v) / len(v) AS mu, list_sum(list_transform(v, lambda x: x * x)) / len(v) AS sq, list_min(v) AS lo, list_max(v) AS hi FROM e) SELECT vec_id, round(v[1] / list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2, round(v[1] / list_max(list_transform(v, lambda x: abs(x))), 6) AS linf, round((v[1] - lo) / (hi - lo), 6) AS minmax, round((v[1] - mu) / sqrt(sq - mu * mu), 6) AS zscore, round(v[1] / sqrt(sq - mu * mu), 6) AS unit_variance FROM n")
def normalised_by(spark, sf):
    """A vector's first coordinate under each of six normalisations."""
    e = emb(spark, sf).select("vec_id", "v", (add(F.col("v")) / F.size("v")).alias("mu"), (V.dot(F.col("v"), F.col("v")) / F.size("v")).alias("sq"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    x, sd = F.col("v")[0], F.sqrt(F.col("sq") - F.col("mu") * F.col("mu"))
    cols = {"l1": x / add(F.transform("v", F.abs)), "l2": x / V.norm(F.col("v")), "linf": x / F.array_max(F.transform("v", F.abs)), "minmax": (x - F.col("lo")) / (F.col("hi") - F.col("lo")), "zscore": (x - F.col("mu")) / sd, "unit_variance": x / sd}
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query(f"WITH {_E} SELECT vec_id, len(list_filter(v, lambda x: abs(x) > 0.15)) AS clipped, round(sqrt(list_sum(list_transform(v, lambda x: pow(greatest(least(x, 0.15), -0.15), 2)))), 6) AS norm FROM e")
def clipped_vectors(spark, sf):
    c = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(0.15)), F.lit(-0.15)))
    return emb(spark, sf).select("vec_id", F.size(F.filter("v", lambda x: F.abs(x) > 0.15)).cast("long").alias("clipped"), F.round(V.norm(c), 6).alias("norm"))


@query(f"WITH {_E}, s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e), q AS (SELECT vec_id, v, scale, list_transform(v, lambda x: CASE WHEN scale > 0 THEN floor(x / scale + 0.5) ELSE 0 END) AS q FROM s) SELECT vec_id, round(scale, 8) AS scale, CAST(list_sum(q) AS BIGINT) AS total, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(v[i] - q[i] * scale, 2)))), 6) AS error FROM q")
def int8_vectors(spark, sf):
    """Signed bytes by the largest coordinate, and the error of what they are turned back into."""
    s = emb(spark, sf).withColumn("scale", F.array_max(F.transform("v", F.abs)) / 127)
    q = s.withColumn("q", F.transform("v", lambda x: F.when(F.col("scale") > 0, F.floor(x / F.col("scale") + 0.5)).otherwise(0).cast("double")))
    # Formed before `scale` is rounded: inside a lambda the name would mean the rounded column beside it.
    q = q.withColumn("back", F.zip_with("v", "q", lambda x, y: x - y * F.col("scale")))
    return q.select("vec_id", F.round("scale", 8).alias("scale"), add(F.col("q")).cast("long").alias("total"), F.round(V.norm(F.col("back")), 6).alias("error"))


_BITS = "(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN v[i + {a}] > 0 THEN (1::BIGINT << i) ELSE 0 END)))::BIGINT"


def signs(v, at):
    return F.aggregate(F.transform(F.slice(v, at + 1, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


@query(f"WITH {_E}, b AS (SELECT vec_id, {_BITS.format(a=1)} AS lo, {_BITS.format(a=33)} AS hi FROM e) SELECT a.vec_id, a.lo, a.hi, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::INT AS to_next FROM b a JOIN b b ON b.vec_id = a.vec_id + 1")
def binary_vectors(spark, sf):
    """Sign bits, and their Hamming distance to the next vector's."""
    b = emb(spark, sf).select("vec_id", signs(F.col("v"), 0).alias("lo"), signs(F.col("v"), 32).alias("hi"))
    n = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return b.join(n, "vec_id").select("vec_id", "lo", "hi", (F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2")))).alias("to_next"))


_BAND = "(list_sum(list_transform(range(0, 16), lambda i: CASE WHEN v[i + {a}] > 0 THEN (1::BIGINT << i) ELSE 0 END)))::BIGINT"


@query(f"WITH {_E}, k AS (SELECT vec_id, v, unnest([0, 1, 2, 3]) AS band, unnest([{', '.join(_BAND.format(a=16 * b + 1) for b in range(4))}]) AS key FROM e) SELECT DISTINCT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM k a JOIN k b USING (band, key) WHERE a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.3")
def lsh_dups(spark, sf):
    """Pairs with the signs of a band of 16 coordinates in common, by exact cosine."""
    e = emb(spark, sf)
    bits = lambda at: F.aggregate(F.transform(F.slice("v", at + 1, 16), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda s, x: s + x)
    k = e.select("vec_id", "v", F.posexplode(F.array(*[bits(16 * b) for b in range(4)])).alias("band", "key"))
    j = k.select("band", "key", F.col("vec_id").alias("a"), F.col("v").alias("x")).join(k.select("band", "key", F.col("vec_id").alias("b"), F.col("v").alias("y")), ["band", "key"])
    s = j.where("a < b").select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("score"))
    return s.where("score >= 0.3").distinct()


@query(f"WITH {_E} SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * ((i * 7 + {j} * 13 + i * {j}) % 3 - 1))) / sqrt(4.0), 6) AS p{j}" for j in range(4)) + " FROM e")
def random_projection(spark, sf):
    """Four coordinates by a matrix of -1, 0 and 1 from a rule."""
    row = lambda j: add(F.transform("v", lambda x, i: x * (((i + 1) * 7 + 13 * j + (i + 1) * j) % 3 - 1)))
    return emb(spark, sf).select("vec_id", *[F.round(row(j) / 2.0, 6).alias(f"p{j}") for j in range(4)])


@query(f"WITH {_E} SELECT vec_id, round(t[1] / sqrt(list_sum(list_transform(t, lambda x: x * x))), 6) AS first, round(sqrt(list_sum(list_transform(t, lambda x: x * x))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS kept FROM (SELECT vec_id, v, v[1:16] AS t FROM e)")
def truncated_vectors(spark, sf):
    """The first 16 coordinates at length one, and the share of the length that they keep."""
    t = F.slice("v", 1, 16)
    return emb(spark, sf).select("vec_id", F.round(F.col("v")[0] / V.norm(t), 6).alias("first"), F.round(V.norm(t) / V.norm(F.col("v")), 6).alias("kept"))


@query()
def principal_components(spark, sf):
    """Coordinates on the two axes of largest variance."""
    e = table(spark, sf, "embeddings")
    p = O.project(F.col("embedding"), *O.principal_axes(e, 2))
    return e.select("vec_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))


def books(spark, sf, parts=8, k=16):
    """Product quantiser: in each of 8 slices, 16 centres, begun with the vectors of smallest ids."""
    e = table(spark, sf, "embeddings")
    rows = e.orderBy("vec_id").limit(k).select("embedding").collect()
    first = np.array([r["embedding"] for r in rows], float)
    return O.lloyd(e, first.reshape(len(first), parts, -1).transpose(1, 0, 2), 5)


@query()
def product_codes(spark, sf):
    return O.product_codes(table(spark, sf, "embeddings"), books(spark, sf))


@query()
def asymmetric_search(spark, sf):
    """The twenty coded vectors nearest to vector 0, by distances from a table."""
    e, b = table(spark, sf, "embeddings"), books(spark, sf)
    q = e.where("vec_id = 0").first()
    c = O.product_codes(e, b)
    return S.top_k(c.select("vec_id", F.round(-O.asymmetric(F.col("codes"), np.array(q["embedding"], float), b), 6).alias("score")), 20, "vec_id")


@query()
def kmeans_lloyd(spark, sf):
    """(vec_id, cluster) of plain k-means with five centres begun at the first vectors."""
    e = table(spark, sf, "embeddings")
    first = np.array([r["embedding"] for r in e.orderBy("vec_id").limit(5).select("embedding").collect()], float)[None]
    return O.product_codes(e, O.lloyd(e, first, 8)).select("vec_id", F.col("codes")[0].alias("cluster"))


def _linkage(how):
    def f(spark, sf):
        from .search import centroids

        e = table(spark, sf, "embeddings")
        rows = centroids(e).join(e.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").orderBy("label").collect()  # a row a label
        merges = O.hierarchy(np.array([r["c"] for r in rows]), np.array([r["n"] for r in rows]), how)
        names = [r["label"] for r in rows]
        return spark.createDataFrame([(i, names[a], names[b], round(d, 6)) for i, (a, b, d) in enumerate(merges)], "step int, a int, b int, distance double")

    f.__name__ = f"hierarchy_{how}"
    query()(f)


for _how in ("single", "complete", "average", "ward"):
    _linkage(_how)


@query(f"WITH {_C}, q AS (SELECT label, COUNT(*) AS n, SUM(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) / COUNT(*) AS q FROM embeddings GROUP BY label), d AS (SELECT vec_id, e.label AS own, c.label, n, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) + q - 2 * list_inner_product(embedding::DOUBLE[], c) AS d FROM embeddings e, c JOIN q USING (label)), s AS (SELECT vec_id, own, max(CASE WHEN label = own THEN d * n / (n - 1) END) AS a, min(CASE WHEN label <> own THEN d END) AS b FROM d GROUP BY vec_id, own) SELECT own AS label, COUNT(*) AS n, round(AVG((b - a) / greatest(a, b)), 5) AS silhouette FROM s GROUP BY own")
def silhouette(spark, sf):
    """The mean silhouette of each label, by squared distances; the labels' table has a row each."""
    s = O.silhouettes(table(spark, sf, "embeddings"), "label", "embedding")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 5).alias("silhouette"))


@query(f"""WITH {_E}, d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.v, b.v), 6) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 10),
k AS (SELECT a, max(d) AS kd FROM r GROUP BY a), l AS (SELECT r.a, 1 / greatest(AVG(greatest(d, kd)), 1e-12) AS density FROM r JOIN k ON k.a = r.b GROUP BY r.a) SELECT r.a AS query, round(AVG(l.density) / any_value(o.density), 4) AS lof FROM r JOIN l ON l.a = r.b JOIN l o ON o.a = r.a WHERE r.a % 100 = 0 GROUP BY r.a""")
def outlier_factors(spark, sf):
    """Local outlier factors of every hundredth vector among all."""
    e = table(spark, sf, "embeddings")
    return O.outlier_factors(e, e.where("vec_id % 100 = 0")).select("query", F.round("lof", 4).alias("lof"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT i, AVG(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i), z AS (SELECT vec_id, i, abs(x - m) / s AS z FROM x JOIN m USING (i) WHERE s > 0),
v AS (SELECT vec_id, max(z) AS top, sqrt(AVG(z * z)) AS mah, AVG(CASE WHEN z > 1 AND z / (z + 1) > ((i * 37 + 11) % 100) / 100.0 THEN 1.0 ELSE 0.0 END) AS iso FROM z GROUP BY vec_id)
SELECT vec_id, round(top, 5) AS zscore, round(mah, 5) AS mahalanobis, round(iso, 6) AS isolation, (CASE WHEN top > 3 THEN 1 ELSE 0 END + CASE WHEN mah > 1.1 THEN 1 ELSE 0 END + CASE WHEN iso > 0.2 THEN 1 ELSE 0 END) AS votes FROM v""")
def anomaly_votes(spark, sf):
    """Three scores and how many of them speak for an outlier: one row of moments is broadcast, nothing is exploded a second time."""
    e = emb(spark, sf)
    m = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    m = m.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("ms"))
    z = e.join(F.broadcast(m)).select("vec_id", F.filter(F.zip_with("v", "ms", lambda x, k: F.struct(F.when(k["s"] > 0, F.abs(x - k["m"]) / k["s"]).alias("z"), k["i"].alias("i"))), lambda q: q["z"].isNotNull()).alias("z"))
    top, mah = F.array_max(F.transform("z", lambda q: q["z"])), F.sqrt(add(F.transform("z", lambda q: q["z"] * q["z"])) / F.size("z"))
    iso = F.size(F.filter("z", lambda q: (q["z"] > 1) & (q["z"] / (q["z"] + 1) > ((q["i"] * 37 + 11) % 100) / 100.0))) / F.size("z")
    s = z.select("vec_id", top.alias("top"), mah.alias("mah"), iso.alias("iso"))
    votes = sum((c.cast("int") for c in (F.col("top") > 3, F.col("mah") > 1.1, F.col("iso") > 0.2)), F.lit(0))
    return s.select("vec_id", F.round("top", 5).alias("zscore"), F.round("mah", 5).alias("mahalanobis"), F.round("iso", 6).alias("isolation"), votes.alias("votes"))


@query(f"WITH {_E} SELECT vec_id, len(v) AS dims, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(v, lambda x: x * x)) / len(v) - pow(list_sum(v) / len(v), 2), 8) AS variance, len(list_filter(v, lambda x: abs(x) < 0.01)) / len(v)::DOUBLE AS sparsity, len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 AS broken FROM e")
def vector_quality(spark, sf):
    v = F.col("v")
    mean = add(v) / F.size("v")
    return emb(spark, sf).select("vec_id", F.size("v").cast("long").alias("dims"), F.round(V.norm(v), 6).alias("norm"), F.round(V.dot(v, v) / F.size("v") - mean * mean, 8).alias("variance"), (F.size(F.filter("v", lambda x: F.abs(x) < 0.01)) / F.size("v")).alias("sparsity"), F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("broken"))


_U = "(('0x' || substr(md5(vec_id::VARCHAR || '|' || i::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE"


@query(f"WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), u AS (SELECT vec_id, x, {_U} - 0.5 AS u FROM x) SELECT vec_id, round(sqrt(SUM(pow(x - 0.05::DOUBLE * sign(u) * ln(1 - 2 * abs(u)), 2))), 5) AS norm, round(AVG(abs(0.05::DOUBLE * ln(1 - 2 * abs(u)))), 6) AS noise FROM u GROUP BY vec_id")
def noisy_vectors(spark, sf):
    """Vectors under Laplace noise drawn from a hash, so that a rerun draws the same."""
    u = lambda i: (F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("|"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 - 0.5
    noise = F.transform("v", lambda x, i: -0.05 * F.signum(u(i)) * F.log(1 - 2 * F.abs(u(i))))
    e = emb(spark, sf).withColumn("noise", noise)
    return e.select("vec_id", F.round(V.norm(F.zip_with("v", "noise", lambda x, y: x + y)), 5).alias("norm"), F.round(add(F.transform("noise", F.abs)) / F.size("noise"), 6).alias("noise"))


_UK = "(('0x' || substr(md5({k}), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE"


@query(f"WITH g AS (SELECT event_type, SUM(greatest(least(value, 50.0), 0.0)) AS total, COUNT(*) AS n FROM events GROUP BY event_type), u AS (SELECT *, {_UK.format(k='event_type')} AS a, {_UK.format(k='event_type || chr(33)')} AS b FROM g) SELECT event_type, round(total - 100.0::DOUBLE * sign(a - 0.5) * ln(1 - 2 * abs(a - 0.5)), 3) AS laplace, round(total + 60.0::DOUBLE * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 3) AS gaussian FROM u")
def private_sums(spark, sf):
    """Sums of values clamped to 0..50, under Laplace and Gaussian noise from a hash of the group."""
    u = lambda k: (F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    g = table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.greatest(F.least("value", F.lit(50.0)), F.lit(0.0))).alias("total"))
    a, b = u(F.col("event_type")), u(F.concat("event_type", F.lit("!")))
    return g.select("event_type", F.round(F.col("total") - 100.0 * F.signum(a - 0.5) * F.log(1 - 2 * F.abs(a - 0.5)), 3).alias("laplace"), F.round(F.col("total") + 60.0 * F.sqrt(-2 * F.log(a)) * F.cos(2 * F.pi() * b), 3).alias("gaussian"))


@query(f"WITH r AS (SELECT event_type, CASE WHEN {_UK.format(k='event_id::VARCHAR')} < 0.75 THEN value > 20 ELSE value <= 20 END AS answer FROM events) SELECT event_type, AVG(CASE WHEN answer THEN 1.0 ELSE 0.0 END) AS told, round((AVG(CASE WHEN answer THEN 1.0 ELSE 0.0 END) - 0.25) / 0.5, 6) AS estimate FROM r GROUP BY event_type")
def randomised_response(spark, sf):
    """The share of large values, from answers that are true three times in four."""
    u = (F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    told = F.when(u < 0.75, F.col("value") > 20).otherwise(F.col("value") <= 20).cast("double")
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(told).alias("told"), F.round((F.avg(told) - 0.25) / 0.5, 6).alias("estimate"))


@query(f"WITH {_E}, p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, len(list_concat(x, y)) AS joined, round((x[1] + y[1]) / 2, 6) AS mean, round(0.7 * x[1] + 0.3 * y[1], 6) AS weighted, round(greatest(x[1], y[1]), 6) AS top, round(list_inner_product(x, y), 6) AS hadamard FROM p")
def composed_vectors(spark, sf):
    """Each vector with the next: joined, averaged, by weight, by maximum, and the sum of their Hadamard product."""
    e = emb(spark, sf)
    p = e.select("vec_id", F.col("v").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("y")), "vec_id")
    x, y = F.col("x")[0], F.col("y")[0]
    return p.select("vec_id", F.size(F.concat("x", "y")).cast("long").alias("joined"), F.round((x + y) / 2, 6).alias("mean"), F.round(0.7 * x + 0.3 * y, 6).alias("weighted"), F.round(F.greatest(x, y), 6).alias("top"), F.round(V.dot(F.col("x"), F.col("y")), 6).alias("hadamard"))


@query("WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT label, i, round(SUM(x * (1 + vec_id % 5)) / SUM(1 + vec_id % 5), 6) AS weighted, round(exp(AVG(ln(abs(x) + 1e-9))), 6) AS geometric, round(SUM(x * exp(4 * x)) / SUM(exp(4 * x)), 6) AS attention FROM x GROUP BY label, i")
def vector_agg_more(spark, sf):
    """Each label's vectors by weighted mean, geometric mean of sizes, and attention by their own values."""
    x = emb(spark, sf).select("label", "vec_id", F.posexplode("v").alias("i", "x"))
    w, e = 1 + F.col("vec_id") % 5, F.exp(4 * F.col("x"))
    return x.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("x") * w) / F.sum(w), 6).alias("weighted"), F.round(F.exp(F.avg(F.log(F.abs("x") + 1e-9))), 6).alias("geometric"), F.round(F.sum(F.col("x") * e) / F.sum(e), 6).alias("attention"))


@query(f"WITH {_E}, m AS (SELECT vec_id, v, list_sum(v) / len(v) AS mu, list_min(v) AS lo, list_max(v) AS hi FROM e), d AS (SELECT *, list_sum(list_transform(v, lambda x: pow(x - mu, 2))) / len(v) AS var FROM m) SELECT vec_id, round(mu, 6) AS mean, round(var, 8) AS variance, round(list_sum(list_transform(v, lambda x: pow(x - mu, 3))) / len(v) / pow(var, 1.5), 5) AS skewness, round(hi - lo, 6) AS spread, " + ", ".join(f"len(list_filter(v, lambda x: least(CAST(floor((x - lo) / ((hi - lo) / 5)) AS INT), 4) = {b})) AS h{b}" for b in range(5)) + " FROM d")
def vector_features(spark, sf):
    """Mean, variance, skewness, range and a histogram of five bins of a vector's coordinates."""
    m = emb(spark, sf).select("vec_id", "v", (add(F.col("v")) / F.size("v")).alias("mu"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    d = m.withColumn("var", add(F.transform("v", lambda x: F.pow(x - F.col("mu"), 2))) / F.size("v"))
    skew = add(F.transform("v", lambda x: F.pow(x - F.col("mu"), 3))) / F.size("v") / F.pow("var", F.lit(1.5))
    at = lambda x: F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 5)), F.lit(4))
    count = lambda b: F.size(F.filter("v", lambda x: at(x) == b)).cast("long")
    bins = [count(b).alias(f"h{b}") for b in range(5)]
    return d.select("vec_id", F.round("mu", 6).alias("mean"), F.round("var", 8).alias("variance"), F.round(skew, 5).alias("skewness"), F.round(F.col("hi") - F.col("lo"), 6).alias("spread"), *bins)


def _half(where):
    return f"SELECT list(m ORDER BY i) AS c, any_value(n) AS n, any_value(q) AS q FROM (SELECT i, AVG(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE {where}) GROUP BY i), (SELECT COUNT(*) AS n, AVG(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS q FROM embeddings WHERE {where})"


@query(f"WITH a AS ({_half('vec_id % 2 = 0')}), b AS ({_half('vec_id % 2 = 1')}), s AS (SELECT 1 - list_cosine_similarity(a.c, b.c) AS moved, 2 * (a.q - list_inner_product(a.c, a.c)) AS wa, 2 * (b.q - list_inner_product(b.c, b.c)) AS wb FROM a, b) SELECT round(moved, 6) AS moved, round(abs(wb - wa) / wa, 6) AS spread, round(0.7 * moved + 0.3 * abs(wb - wa) / wa, 6) AS score, CASE WHEN 0.7 * moved + 0.3 * abs(wb - wa) / wa < 0.1 THEN 'None' WHEN 0.7 * moved + 0.3 * abs(wb - wa) / wa < 0.3 THEN 'Mild' WHEN 0.7 * moved + 0.3 * abs(wb - wa) / wa < 0.6 THEN 'Moderate' ELSE 'Severe' END AS drift FROM s")
def drift_report(spark, sf):
    """Two populations: how far the centroid turned, and how the mean squared distance of pairs changed, from sums alone."""
    def side(where, p):
        e = emb(spark, sf).where(where)
        c = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(f"c{p}"))
        return c.join(e.agg(F.avg(V.dot(F.col("v"), F.col("v"))).alias(f"q{p}")))

    j = side("vec_id % 2 = 0", "a").join(side("vec_id % 2 = 1", "b"))
    wide = lambda p: 2 * (F.col(f"q{p}") - V.dot(F.col(f"c{p}"), F.col(f"c{p}")))
    s = j.select((1 - V.cosine(F.col("ca"), F.col("cb"))).alias("moved"), (F.abs(wide("b") - wide("a")) / wide("a")).alias("spread"))
    x = 0.7 * F.col("moved") + 0.3 * F.col("spread")
    name = F.when(x < 0.1, "None").when(x < 0.3, "Mild").when(x < 0.6, "Moderate").otherwise("Severe")
    return s.select(F.round("moved", 6).alias("moved"), F.round("spread", 6).alias("spread"), F.round(x, 6).alias("score"), name.alias("drift"))


@query("SELECT event_type, round((AVG(value) - 20) / (15.0::DOUBLE / sqrt(COUNT(*))), 5) AS z, round((AVG(value) - 20) / (stddev_samp(value) / sqrt(COUNT(*))), 5) AS t, round((AVG(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) - 0.35) / sqrt(0.35 * 0.65 / COUNT(*)), 5) AS proportion FROM events GROUP BY event_type")
def hypothesis_one_sample(spark, sf):
    """Each type's values against a mean of 20 (by z and t) and its share of large ones against 0.35."""
    v, n = F.col("value"), F.count(F.lit(1))
    share = F.avg((v > 20).cast("double"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.round((F.avg(v) - 20) / (15.0 / F.sqrt(n)), 5).alias("z"), F.round((F.avg(v) - 20) / (F.stddev_samp(v) / F.sqrt(n)), 5).alias("t"), F.round((share - 0.35) / F.sqrt(F.lit(0.35 * 0.65) / n), 5).alias("proportion"))


@query("WITH g AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type), t AS (SELECT SUM(n) / COUNT(*)::DOUBLE AS expected FROM g), p AS (SELECT AVG(CASE WHEN event_type = 'click' THEN (value > 20)::INT END) AS a, AVG(CASE WHEN event_type = 'view' THEN (value > 20)::INT END) AS b, COUNT(*) FILTER (event_type = 'click') AS na, COUNT(*) FILTER (event_type = 'view') AS nb, AVG(CASE WHEN event_type IN ('click', 'view') THEN (value > 20)::INT END) AS pooled FROM events) SELECT round(SUM(pow(n - expected, 2) / expected), 5) AS chi2, COUNT(*) - 1 AS dof, any_value(round((a - b) / sqrt(pooled * (1 - pooled) * (1.0 / na + 1.0 / nb)), 5)) AS two_proportions FROM g, t, p")
def hypothesis_fit(spark, sf):
    """Whether types are equally frequent, and whether two types have the same share of large values."""
    e = table(spark, sf, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 20).cast("long")).alias("big"))
    pick = lambda c, t: F.sum(F.when(F.col("event_type") == t, F.col(c)).otherwise(0))
    s = g.agg(F.sum(F.pow("n", F.lit(2.0))).alias("sq"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[pick(c, t).alias(f"{c}_{t}") for c in ("n", "big") for t in ("click", "view")])
    chi = F.col("sq") / (F.col("n") / F.col("k")) - F.col("n")
    both = (F.col("big_click") + F.col("big_view")) / (F.col("n_click") + F.col("n_view"))
    z = (F.col("big_click") / F.col("n_click") - F.col("big_view") / F.col("n_view")) / F.sqrt(both * (1 - both) * (1 / F.col("n_click") + 1 / F.col("n_view")))
    return s.select(F.round(chi, 5).alias("chi2"), (F.col("k") - 1).alias("dof"), F.round(z, 5).alias("two_proportions"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS f, l_discount AS d FROM lineitem), s AS (SELECT AVG(q) AS m FROM r), o AS (SELECT f AS mode FROM r WHERE f IS NOT NULL GROUP BY f ORDER BY COUNT(*) DESC, f LIMIT 1) SELECT COALESCE(f, mode) AS flag, COUNT(*) AS n, round(SUM(COALESCE(q, m)), 3) AS quantity, SUM(CASE WHEN COALESCE(q, m) > 25 THEN 1 ELSE 0 END)::BIGINT AS large, round(SUM(d * d), 4) AS d2, round(SUM(d * COALESCE(q, m)), 3) AS dq FROM r, s, o GROUP BY 1")
def feature_imputed(spark, sf):
    """Missing numbers by the mean, missing categories by the mode, then binarised and multiplied out."""
    r = table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("f"), F.col("l_discount").alias("d"))
    mode = r.where("f IS NOT NULL").groupBy("f").count().orderBy(F.desc("count"), "f").limit(1).select(F.col("f").alias("mode"))
    x = r.join(F.broadcast(r.agg(F.avg("q").alias("m")))).join(F.broadcast(mode)).select(F.coalesce("f", "mode").alias("flag"), F.coalesce("q", "m").alias("q"), "d")
    return x.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 3).alias("quantity"), F.count_if(F.col("q") > 25).alias("large"), F.round(F.sum(F.col("d") * F.col("d")), 4).alias("d2"), F.round(F.sum(F.col("d") * F.col("q")), 3).alias("dq"))


@query("WITH c AS (SELECT DISTINCT p_brand AS v FROM part), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM c) SELECT p_partkey, place, (SELECT COUNT(*) FROM c) AS width FROM part JOIN k ON v = p_brand")
def feature_onehot_fitted(spark, sf):
    """The place of each category in its sorted list, learned from the table; the list has a row a category."""
    p = table(spark, sf, "part")
    cats = p.select(F.col("p_brand").alias("v")).distinct().agg(F.array_sort(F.collect_list("v")).alias("cats"))
    return p.join(F.broadcast(cats)).select("p_partkey", (F.array_position("cats", F.col("p_brand")) - 1).alias("place"), F.size("cats").cast("long").alias("width"))
