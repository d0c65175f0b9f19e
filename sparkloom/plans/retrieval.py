"""Hybrid retrieval, reranking, feedback, snippets and judging, over documents and the vectors of the same ids."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..functions import vectors as V
from ..operators import rerank as R
from ..operators import search as S
from ..sources.tables import table
from .search import _BM25, _C, _DOT, _N1, _N2, TERMS, centroids

_COS = f"{_DOT} / ({_N1} * {_N2})"
_LISTS = f"""{_BM25}, {_C}, dense AS (SELECT vec_id AS doc_id, round({_COS}, 6) AS score FROM c, embeddings WHERE c.label = 1 ORDER BY score DESC, doc_id LIMIT 100),
sparse AS (SELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 100) """
_UNIT = "{n}n AS (SELECT doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END::DOUBLE AS {n} FROM {t}, (SELECT min(score) AS lo, max(score) AS hi FROM {t}))"
_BOTH = f"{_LISTS}, {_UNIT.format(n='d', t='dense')}, {_UNIT.format(n='s', t='sparse')}, j AS (SELECT doc_id, COALESCE(d, 0) AS d, COALESCE(s, 0) AS s FROM dn FULL JOIN sn USING (doc_id)) "


def dense(spark, sf, k=100, label=1):
    """(doc_id, score): the k vectors nearest to a label's centroid."""
    emb = table(spark, sf, "embeddings")
    c = centroids(emb.where(F.col("label") == label)).select("c")
    s = emb.join(F.broadcast(c)).select(F.col("vec_id").alias("doc_id"), F.round(V.cosine(F.col("c"), F.col("embedding")), 6).alias("score"))
    return s if k is None else S.top_k(s, k)


def sparse(spark, sf, k=100):
    return S.top_k(S.bm25(table(spark, sf, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score")), k)


@query(_BOTH + "SELECT doc_id, round(d * 0.6 + s * 0.4, 6) AS score FROM j ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_dense_sparse(spark, sf):
    return S.top_k(R.blend(dense(spark, sf), sparse(spark, sf), 0.6).withColumn("score", F.round("score", 6)), 20)


@query(_BOTH + "SELECT doc_id, round(d * 0.6 + s * 0.4, 6) AS score, row_number() OVER (ORDER BY round(d * 0.6 + s * 0.4, 6) DESC, doc_id) AS rank FROM j WHERE round(d * 0.6 + s * 0.4, 6) >= 0.3")
def hybrid_min_score(spark, sf):
    """Lists of at most 200 rows: the window without a key holds no more."""
    h = R.blend(dense(spark, sf), sparse(spark, sf), 0.6).withColumn("score", F.round("score", 6)).where("score >= 0.3")
    return h.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).cast("long"))


@query(_LISTS + "SELECT doc_id, round(0.7 * COALESCE(s.score, 0) + 0.3 * d.score, 6) AS score FROM dense d LEFT JOIN sparse s USING (doc_id) WHERE 0.7 * COALESCE(s.score, 0) + 0.3 * d.score >= 0.05")
def lexical_semantic_rank(spark, sf):
    """Lexical and semantic weights on raw scores, with a least score."""
    d, s = dense(spark, sf), sparse(spark, sf).withColumnRenamed("score", "lex")
    x = 0.7 * F.coalesce("lex", F.lit(0.0)) + 0.3 * F.col("score")
    return d.join(s, "doc_id", "left").select("doc_id", x.alias("raw")).where("raw >= 0.05").select("doc_id", F.round("raw", 6).alias("score"))


_SIGNALS = f"""{_BOTH}, g AS (SELECT doc_id, d, s, d.n_chars, CASE WHEN (doc_id % 90 - 5) <= 0 THEN 1.0 ELSE exp(-0.5::DOUBLE * (doc_id % 90 - 5) / 30) END::DOUBLE AS recent,
  len(list_intersect(list_distinct(w), ['{"', '".join(TERMS)}'])) / 5.0::DOUBLE AS tags FROM j JOIN documents d USING (doc_id) JOIN (SELECT doc_id, w FROM tok) USING (doc_id)) """


def signals(spark, sf):
    """(doc_id, d, s, n_chars, recent, tags): a candidate's scaled scores, its recency and the share of the terms that it has."""
    both = R.min_max(dense(spark, sf).withColumnRenamed("score", "d"), "d").join(R.min_max(sparse(spark, sf).withColumnRenamed("score", "s"), "s"), "doc_id", "full")
    both = both.select("doc_id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("s", F.lit(0.0)).alias("s"))
    has = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*[F.lit(t) for t in TERMS])))
    return both.join(table(spark, sf, "documents"), "doc_id").select("doc_id", "d", "s", "n_chars", R.recency((F.col("doc_id") % 90 - 5).cast("double"), 0.5).alias("recent"), (has / 5.0).alias("tags"))


@query(_SIGNALS + "SELECT doc_id, round((d * 0.5 + recent * 0.2 + tags * 0.2 + s * 0.1) / 1.0::DOUBLE, 6) AS score FROM g ORDER BY score DESC, doc_id LIMIT 25")
def rerank_signals(spark, sf):
    """Similarity, recency, tag overlap and text score by weight."""
    s = signals(spark, sf).select("doc_id", F.round(R.weighted({"d": 0.5, "recent": 0.2, "tags": 0.2, "s": 0.1}), 6).alias("score"))
    return S.top_k(s, 25)


@query(_SIGNALS + ", r AS (SELECT *, row_number() OVER (ORDER BY d DESC, doc_id) AS rd, row_number() OVER (ORDER BY s DESC, doc_id) AS rs, row_number() OVER (ORDER BY recent DESC, doc_id) AS rr FROM g) SELECT doc_id, round(1 / (60.0::DOUBLE + rd) + 1 / (60.0::DOUBLE + rs) + 1 / (60.0::DOUBLE + rr), 8) AS score FROM r")
def rerank_rrf(spark, sf):
    """Reciprocal ranks of at most 200 candidates by three components."""
    g = signals(spark, sf)
    rank = lambda c: F.row_number().over(W.orderBy(F.desc(c), "doc_id"))
    return g.select("doc_id", F.round(sum((1 / (60 + rank(c)) for c in ("d", "s", "recent")), F.lit(0.0)), 8).alias("score"))


@query(_SIGNALS + ", r AS (SELECT *, row_number() OVER (ORDER BY d DESC, doc_id) AS prior FROM g) SELECT doc_id, round(0.5 * d + 0.25 * tags - 0.1 * least(n_chars / 20000.0::DOUBLE, 1.0) + 0.05 * (CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) + 0.1 / prior, 6) AS score, prior AS position FROM r")
def rerank_features(spark, sf):
    """Embedding score, keyword overlap, length penalty, boost and position prior, of at most 200 candidates."""
    g = signals(spark, sf).withColumn("prior", F.row_number().over(W.orderBy(F.desc("d"), "doc_id")).cast("long"))
    x = 0.5 * F.col("d") + 0.25 * F.col("tags") - 0.1 * F.least(F.col("n_chars") / 20000.0, F.lit(1.0)) + 0.05 * (F.col("doc_id") % 10 == 0).cast("int") + 0.1 / F.col("prior")
    return g.select("doc_id", F.round(x, 6).alias("score"), F.col("prior").alias("position"))


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query(f"WITH {_Q}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v, q FROM embeddings, q) SELECT vec_id, round(list_inner_product(q, v), 6) AS dot, round(list_cosine_similarity(q, v), 6) AS cosine, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: q[i] * v[i] / i)), 6) AS bilinear, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (q[i] + v[i]) * (i % 3 - 1))), 6) AS linear FROM e")
def pair_scores(spark, sf):
    """A query vector and each row, by four models: dot product, cosine, a diagonal bilinear form and a linear one."""
    emb = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    e = emb.join(F.broadcast(emb.where("vec_id = 0").select(F.col("v").alias("q"))))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weights = F.transform("v", lambda x, i: F.lit(1.0) / (i + 1))
    bilinear = add(F.zip_with(F.zip_with("q", "v", lambda x, y: x * y), weights, lambda x, y: x * y))
    linear = add(F.zip_with(F.zip_with("q", "v", lambda x, y: x + y), F.transform("v", lambda x, i: ((i + 1) % 3 - 1).cast("double")), lambda x, y: x * y))
    return e.select("vec_id", F.round(V.dot(F.col("q"), F.col("v")), 6).alias("dot"), F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("cosine"), F.round(bilinear, 6).alias("bilinear"), F.round(linear, 6).alias("linear"))


@query(_LISTS + ", n AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS before, row_number() OVER (ORDER BY score * (1 + greatest((doc_id % 7 - 3) / 10.0::DOUBLE, -0.9)) DESC, doc_id) AS after FROM dense) SELECT doc_id, before, after, before <> after AS moved FROM n")
def rank_changes(spark, sf):
    """Places of at most 100 hits before and after a boost of each."""
    d = dense(spark, sf).withColumn("new", F.col("score") * (1 + F.greatest((F.col("doc_id") % 7 - 3) / 10.0, F.lit(-0.9))))
    rank = lambda c: F.row_number().over(W.orderBy(F.desc(c), "doc_id")).cast("long")
    return d.select("doc_id", rank("score").alias("before"), rank("new").alias("after")).withColumn("moved", F.col("before") != F.col("after"))


@query(_LISTS + ", f AS (SELECT doc_id, SUM(CASE WHEN quality = 1 THEN 0.3 ELSE -1.2 END)::DOUBLE AS boost FROM labels GROUP BY doc_id) SELECT doc_id, round(score * (1 + greatest(COALESCE(boost, 0), -0.9)), 6) AS score FROM dense LEFT JOIN f USING (doc_id)")
def feedback_boosts(spark, sf):
    """Scores times one plus what users' marks add up to, -0.9 at least."""
    f = table(spark, sf, "labels").groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 1, 0.3).otherwise(-1.2)).alias("boost"))
    return dense(spark, sf).join(f, "doc_id", "left").select("doc_id", F.round(F.col("score") * (1 + F.greatest(F.coalesce("boost", F.lit(0.0)), F.lit(-0.9))), 6).alias("score"))


@query(_LISTS + ", b AS (SELECT doc_id, CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 0.8 END::DOUBLE AS cat, CASE WHEN doc_id % 9 = 0 THEN 1.5 END::DOUBLE AS own FROM documents) SELECT doc_id, round(score * COALESCE(cat, 1.0) * COALESCE(own, 1.0), 6) AS score FROM dense LEFT JOIN b USING (doc_id)")
def personal_bias(spark, sf):
    """Scores times a user's boost of the category and of the document itself; 1 where the user has none."""
    cat, own = F.when(F.col("lang") == "en", 1.2).when(F.col("lang") == "de", 0.8), F.when(F.col("doc_id") % 9 == 0, 1.5)
    b = table(spark, sf, "documents").select("doc_id", cat.alias("cat"), own.alias("own"))
    return dense(spark, sf).join(b, "doc_id", "left").select("doc_id", F.round(F.col("score") * F.coalesce("cat", F.lit(1.0)) * F.coalesce("own", F.lit(1.0)), 6).alias("score"))


def _mean_sql(name, where):
    return f"{name} AS (SELECT list(m ORDER BY i) AS {name} FROM (SELECT i, AVG(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE {where}) GROUP BY i))"


def mean_vector(vectors, name):
    """One row: the mean of each coordinate, added up as rows of coordinates."""
    each = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(name))


@query(f"WITH {_Q}, {_mean_sql('liked', 'label = 1 AND vec_id % 5 = 0')}, {_mean_sql('bad', 'label = 2 AND vec_id % 5 = 0')}, n AS (SELECT list_transform(range(1, len(q) + 1), lambda i: q[i] + 0.75 * COALESCE(liked[i], 0) - 0.15 * COALESCE(bad[i], 0)) AS n FROM q, liked, bad), s AS (SELECT vec_id, round(list_cosine_similarity(n, embedding::DOUBLE[]), 6) AS score FROM embeddings, n) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20")
def rocchio_search(spark, sf):
    """A query moved towards what was liked and away from what wasn't, searched anew."""
    emb = table(spark, sf, "embeddings")
    q = emb.where("vec_id = 0").select(V.doubles(F.col("embedding")).alias("q"))
    moved = q.join(mean_vector(emb.where("label = 1 AND vec_id % 5 = 0"), "liked")).join(mean_vector(emb.where("label = 2 AND vec_id % 5 = 0"), "bad"))
    moved = moved.select(R.rocchio(F.col("q"), F.col("liked"), F.col("bad")).alias("n"))
    s = emb.join(F.broadcast(moved)).select("vec_id", F.round(V.cosine(F.col("n"), F.col("embedding")), 6).alias("score"))
    return S.top_k(s, 20, "vec_id")


@query(f"WITH {_C}, s AS (SELECT lang, doc_id, round({_COS}, 6) AS score FROM c, embeddings JOIN documents ON doc_id = vec_id WHERE c.label = 1 AND lang IN ('de', 'fr')), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) - 1 AS rank FROM s) SELECT lang, rank, doc_id, score FROM r WHERE rank < 10")
def multilingual_search(spark, sf):
    """The ten nearest of each wanted language, counted from 0."""
    d = table(spark, sf, "documents").where("lang IN ('de', 'fr')").select("doc_id", "lang")
    s = dense(spark, sf, k=None).join(d, "doc_id")
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), "doc_id")) - 1)
    return r.where("rank < 10").select("lang", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _modal(how):
    part = {"max": "greatest(d, s)", "sum": "d + s", "mean": "(d + s) / 2", "weighted": "(d * 0.4 + s * 0.4) / 0.8::DOUBLE", "text_primary": "CASE WHEN s > 0 THEN s ELSE d * 0.5 END", "union": "CASE WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN s > 0 THEN 1 ELSE 0 END"}[how]

    def f(spark, sf):
        d, s = F.col("d"), F.col("s")
        x = {"max": F.greatest(d, s), "sum": d + s, "mean": (d + s) / 2, "weighted": (d * 0.4 + s * 0.4) / 0.8, "text_primary": F.when(s > 0, s).otherwise(d * 0.5), "union": (d > 0).cast("int") + (s > 0).cast("int")}[how]
        return signals(spark, sf).select("doc_id", F.round(x.cast("double"), 6).alias("score"))

    f.__name__ = f"modal_{how}"
    query(_SIGNALS + f"SELECT doc_id, round(({part})::DOUBLE, 6) AS score FROM g")(f)


for _m in ("max", "sum", "mean", "weighted", "text_primary", "union"):
    _modal(_m)


@query(_LISTS + "SELECT doc_id, score FROM dense WHERE doc_id IN (SELECT doc_id FROM sparse) AND score >= 0.0")
def quorum_merge(spark, sf):
    """Hits that both lists have."""
    return dense(spark, sf).join(sparse(spark, sf).select("doc_id"), "doc_id", "left_semi").where("score >= 0.0")


@query(f"WITH {_C}, s AS (SELECT c.label AS shard, vec_id, round({_COS}, 6) AS score FROM c, embeddings WHERE c.label < 3), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, vec_id) AS r FROM s) SELECT vec_id, MAX(score) AS score FROM r WHERE r <= 30 GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 40")
def federated_merge(spark, sf):
    """Lists of three indexes merged, each id with its best score."""
    lists = None
    for label in range(3):
        one = S.top_k(dense(spark, sf, None, label), 30)
        lists = one if lists is None else lists.unionByName(one)
    return S.top_k(R.best_of(lists.withColumnRenamed("doc_id", "vec_id"), "vec_id", "score"), 40, "vec_id")


@query(_BM25 + ", x AS (SELECT d.doc_id, string_split_regex(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), ' ') AS w FROM h JOIN documents d USING (doc_id)), y AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))), 'thing') AS pos FROM x) SELECT doc_id, array_to_string(list_slice(w, greatest(pos - 5, 1), pos + 5), ' ') AS snippet FROM y WHERE pos > 0")
def snippets(spark, sf):
    """Five words on either side of the first hit of a term."""
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    at = F.array_position(F.transform("w", lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))), "thing").cast("int")
    p = docs.withColumn("at", at).where("at > 0")
    return p.select("doc_id", F.array_join(F.slice("w", F.greatest(F.col("at") - 5, F.lit(1)), F.col("at") + 6 - F.greatest(F.col("at") - 5, F.lit(1))), " ").alias("snippet"))


@query(_SIGNALS + "SELECT doc_id, feature, round(part, 6) AS part, round(part / sum(part) OVER (PARTITION BY doc_id), 6) AS share FROM (SELECT doc_id, unnest(['dense', 'sparse', 'recent', 'tags']) AS feature, unnest([d * 0.5, s * 0.1, recent * 0.2, tags * 0.2]) AS part FROM g)")
def explained_scores(spark, sf):
    """A hit's score by feature, and each feature's share."""
    parts = {"dense": F.col("d") * 0.5, "sparse": F.col("s") * 0.1, "recent": F.col("recent") * 0.2, "tags": F.col("tags") * 0.2}
    total = sum(parts.values(), F.lit(0.0))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("part")) for k, v in parts.items()])).alias("e")
    return signals(spark, sf).select("doc_id", total.alias("total"), rows).select("doc_id", "e.feature", F.round("e.part", 6).alias("part"), F.round(F.col("e.part") / F.col("total"), 6).alias("share"))


@query(_SIGNALS + ", two AS (SELECT *, row_number() OVER (ORDER BY d DESC, doc_id) AS r FROM g), f AS (SELECT r, unnest(['dense', 'sparse', 'recent', 'tags']) AS feature, unnest([d, s, recent, tags]) AS part FROM two WHERE r <= 2) SELECT feature, round(max(CASE WHEN r = 1 THEN part END) - max(CASE WHEN r = 2 THEN part END), 6) AS gap FROM f GROUP BY feature")
def compared_explanations(spark, sf):
    """What the two best hits differ by, feature by feature."""
    two = signals(spark, sf).orderBy(F.desc("d"), "doc_id").limit(2)
    r = two.withColumn("r", F.row_number().over(W.orderBy(F.desc("d"), "doc_id")))
    rows = r.select("r", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).alias("part")) for k, c in (("dense", "d"), ("sparse", "s"), ("recent", "recent"), ("tags", "tags"))])).alias("e"))
    return rows.groupBy("e.feature").agg(F.round(F.max(F.when(F.col("r") == 1, F.col("e.part"))) - F.max(F.when(F.col("r") == 2, F.col("e.part"))), 6).alias("gap"))


_KNN = "q AS (SELECT vec_id AS query, label AS ql, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, ql, vec_id, label, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)"


def batch_hits(spark, sf, k=10):
    """(query, rank, vec_id, score, hit): the neighbours of every hundredth vector, and whether they share its label."""
    e = table(spark, sf, "embeddings")
    n = S.nearest(e, e.where("vec_id % 100 = 0"), "cosine", k)
    own, ask = e.select("vec_id", "label"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    return n.join(own, "vec_id").join(ask, "query").withColumn("hit", (F.col("label") == F.col("ql")).cast("long"))


@query(f"WITH {_KNN}, p AS (SELECT query, rank, CASE WHEN label = ql THEN 1 ELSE 0 END AS hit, SUM(CASE WHEN label = ql THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) AS so_far FROM r WHERE rank <= 10), n AS (SELECT query, COUNT(*) AS n FROM q JOIN embeddings ON label = ql AND vec_id <> query GROUP BY query) SELECT query, round(COALESCE(SUM(hit * so_far / rank::DOUBLE) / least(max(n), 10), 0), 6) AS ap, round(COALESCE(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS rr, SUM(hit)::BIGINT AS hits FROM p JOIN n USING (query) GROUP BY query")
def average_precision(spark, sf):
    """AP, reciprocal rank and hits of every hundredth vector's ten neighbours, relevant where they share its label."""
    e = table(spark, sf, "embeddings")
    n = e.groupBy(F.col("label").alias("ql")).agg((F.count(F.lit(1)) - 1).alias("n"))
    relevant = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql")).join(n, "ql").where("n > 0").select("query", "n")
    ap = R.average_precision(batch_hits(spark, sf), relevant, 10)
    return ap.select("query", F.round("ap", 6).alias("ap"), F.round("rr", 6).alias("rr"), "hits")


@query(f"WITH {_KNN}, a AS (SELECT query, AVG(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS p, AVG(score) AS m, COUNT(*) AS n FROM r WHERE rank <= 10 GROUP BY query) SELECT COUNT(*) AS queries, SUM(n)::BIGINT AS results, round(AVG(n), 6) AS mean_results, round(AVG(m), 6) AS mean_score, round(AVG(p), 6) AS mean_precision FROM a")
def batch_search_stats(spark, sf):
    per = batch_hits(spark, sf).groupBy("query").agg(F.avg("hit").alias("p"), F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("results"), F.round(F.avg("n"), 6).alias("mean_results"), F.round(F.avg("m"), 6).alias("mean_score"), F.round(F.avg("p"), 6).alias("mean_precision"))


@query(f"WITH {_KNN} SELECT query, vec_id, score, CASE WHEN score >= 0.95 THEN 'Duplicate' WHEN score >= 0.4 THEN 'Similar' WHEN score <= -0.2 THEN 'Contradictory' WHEN score >= 0.32 THEN 'Related' ELSE 'Unrelated' END AS link FROM r WHERE rank <= 10")
def link_labels(spark, sf):
    """Links of every hundredth vector to its ten nearest, named by their score."""
    s = F.col("score")
    link = F.when(s >= 0.95, "Duplicate").when(s >= 0.4, "Similar").when(s <= -0.2, "Contradictory").when(s >= 0.32, "Related").otherwise("Unrelated")
    e = table(spark, sf, "embeddings")
    return S.nearest(e, e.where("vec_id % 100 = 0"), "cosine", 10).select("query", "vec_id", "score", link.alias("link"))


@query(f"WITH {_KNN}, t AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT min(score) AS lo, max(score) AS hi FROM t) SELECT least(CAST(CASE WHEN hi > lo THEN floor((score - lo) / ((hi - lo) / 10)) ELSE 0 END AS BIGINT), 9) AS bucket, COUNT(*) AS n, round(AVG(score), 6) AS mean, min(score) AS least, max(score) AS most FROM t, b GROUP BY 1")
def search_aggregations(spark, sf):
    """Ten equal buckets over the hits' scores, the last one closed."""
    t = batch_hits(spark, sf)
    x = t.join(F.broadcast(t.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))))
    bucket = F.least(F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10))).otherwise(F.lit(0)), F.lit(9)).cast("long")
    return x.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(_LISTS + "SELECT doc_id, score FROM dense WHERE score BETWEEN 0.1 AND 0.6 AND starts_with(doc_id::VARCHAR, '1') ORDER BY score DESC, doc_id LIMIT 10")
def hits_filtered(spark, sf):
    """Hits by least and largest score, by the beginning of their id, and at most ten."""
    h = dense(spark, sf).where("score BETWEEN 0.1 AND 0.6").where(F.col("doc_id").cast("string").startswith("1"))
    return S.top_k(h, 10)


def _filtered(how):
    def f(spark, sf):
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
        s = dense(spark, sf, None).join(e, "doc_id").withColumn("final", F.round(F.col("score") * R.recency((F.col("doc_id") % 90 - 5).cast("double"), 0.5), 6))
        s = s.where("label IN (1, 2)") if how == "pre" else s.orderBy(F.desc("score"), "doc_id").limit(50).where("label IN (1, 2)")
        return s.where("final >= 0.01").orderBy(F.desc("final"), "doc_id").limit(10).select(F.col("doc_id").alias("vec_id"), "final")

    f.__name__ = f"knn_{how}filter"
    base = f"WITH {_C}, s AS (SELECT vec_id, e.label, round({_COS}, 6) AS score FROM c, embeddings e WHERE c.label = 1)"
    aged = "round(score * CASE WHEN (vec_id % 90 - 5) <= 0 THEN 1.0 ELSE exp(-0.5::DOUBLE * (vec_id % 90 - 5) / 30) END::DOUBLE, 6) AS final"
    rows = "s" if how == "pre" else "(SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50)"
    query(f"{base}, x AS (SELECT vec_id, label, {aged} FROM {rows}) SELECT vec_id, final FROM x WHERE label IN (1, 2) AND final >= 0.01 ORDER BY final DESC, vec_id LIMIT 10")(f)


for _m in ("pre", "post"):
    _filtered(_m)


@query(_SIGNALS + ", f AS (SELECT doc_id, round(0.6 * d + 0.4 * s, 6) AS fused, round(0.5 * d + 0.25 * tags + 0.2 * recent, 6) AS again FROM g ORDER BY fused DESC, doc_id LIMIT 30), u AS (SELECT f.doc_id, again FROM f JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY again DESC, f.doc_id) = 1) SELECT doc_id, again AS score FROM u WHERE again >= 0.1 ORDER BY again DESC, doc_id LIMIT 10")
def search_stages(spark, sf):
    """Candidates of both lists, fused, the best thirty reranked, equal texts once, a least score, the best ten."""
    g = signals(spark, sf).select("doc_id", F.round(0.6 * F.col("d") + 0.4 * F.col("s"), 6).alias("score"), F.round(0.5 * F.col("d") + 0.25 * F.col("tags") + 0.2 * F.col("recent"), 6).alias("again"))
    f = S.top_k(g, 30).join(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("cid")), "doc_id")
    u = f.withColumn("r", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("again"), "doc_id"))).where("r = 1 AND again >= 0.1")
    return S.top_k(u.select("doc_id", F.col("again").alias("score")), 10)


@query(f"WITH {_C}, s AS (SELECT a.label, b.label AS other, round(list_cosine_similarity(a.c, b.c), 6) AS score FROM c a JOIN c b ON a.label <> b.label) SELECT label, other, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, other) <= 3")
def similar_concepts(spark, sf):
    """The three labels nearest to each label; a row a label on either side."""
    c = centroids(table(spark, sf, "embeddings"))
    s = c.select("label", F.col("c").alias("x")).join(c.select(F.col("label").alias("other"), F.col("c").alias("y"))).where("label <> other")
    s = s.select("label", "other", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "other"))).where("r <= 3").drop("r")


@query("WITH p AS (SELECT vec_id AS intent, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 5), s AS (SELECT e.vec_id, intent, round(list_cosine_similarity(c, embedding::DOUBLE[]), 6) AS score FROM embeddings e, p), r AS (SELECT vec_id, max(score) AS best, arg_max(intent, score - intent * 1e-9) AS intent, list_sort(list(score))[-2] AS second FROM s GROUP BY vec_id) SELECT vec_id, CASE WHEN best >= 0.2 THEN intent END AS intent, best AS score, round(best - second, 6) AS margin FROM r")
def intents(spark, sf):
    """The nearest of five prototypes, if near enough, and how far ahead of the next it is."""
    e = table(spark, sf, "embeddings")
    p = e.where("vec_id < 5").agg(F.collect_list(F.struct(F.col("vec_id").alias("intent"), F.col("embedding").alias("c"))).alias("p"))
    scored = F.transform("p", lambda k: F.struct(F.round(V.cosine(k["c"], F.col("embedding")), 6).alias("score"), (-k["intent"]).alias("back")))
    r = e.join(F.broadcast(p)).select("vec_id", F.sort_array(scored, False).alias("s"))
    best, second = F.col("s")[0], F.col("s")[1]
    return r.select("vec_id", F.when(best["score"] >= 0.2, -best["back"]).alias("intent"), best["score"].alias("score"), F.round(best["score"] - second["score"], 6).alias("margin"))


@query(f"WITH {_C}, m AS (SELECT vec_id, label % 2 AS kind, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 3), s AS (SELECT vec_id, c.label AS entity, round(list_cosine_similarity(c, v), 6) AS score FROM m JOIN c ON c.label % 2 = kind) SELECT vec_id, arg_max(entity, score - entity * 1e-9) AS entity, max(score) AS score FROM s GROUP BY vec_id")
def entity_links(spark, sf):
    """Mentions linked to the nearest entity of their kind."""
    e = table(spark, sf, "embeddings")
    c = centroids(e).groupBy((F.col("label") % 2).alias("kind")).agg(F.collect_list(F.struct("label", "c")).alias("cs"))
    m = e.where("vec_id % 10 = 3").withColumn("kind", F.col("label") % 2).join(F.broadcast(c), "kind")
    scored = F.transform("cs", lambda k: F.struct(F.round(V.cosine(k["c"], F.col("embedding")), 6).alias("score"), (-k["label"]).alias("back")))
    return m.select("vec_id", F.array_max(scored).alias("b")).select("vec_id", (-F.col("b.back")).alias("entity"), F.col("b.score").alias("score"))
