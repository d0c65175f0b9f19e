"""Text and vector search queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..functions import vectors as V
from ..operators import search as S
from ..sources.shared import kept
from ..sources.tables import table

TERMS = ["thing", "reer", "ation", "der", "heit"]
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = f"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS w, lang FROM documents)"""
_BM25 = (
    f"""WITH {_TOK}, len AS (SELECT doc_id, lang, len(w) AS dl FROM tok), st AS (SELECT COUNT(*) AS n, AVG(dl) AS al FROM len),
p AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) WHERE term IN ({", ".join(f"'{t}'" for t in TERMS)}) GROUP BY ALL),
d AS (SELECT term, COUNT(*) AS df FROM p GROUP BY term),
h AS (SELECT p.doc_id, SUM(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))) AS score, COUNT(*) AS matched
  FROM p JOIN d USING (term) JOIN len ON len.doc_id = p.doc_id, st GROUP BY p.doc_id) """
)


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score, matched FROM h")
def bm25_scores(spark, sf):
    h = S.bm25(table(spark, sf, "documents"), TERMS)
    return h.select("doc_id", F.round("score", 6).alias("score"), F.col("matched").cast("long").alias("matched"))


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    h = S.bm25(table(spark, sf, "documents"), TERMS).withColumn("score", F.round("score", 9))
    return S.top_k(h, 20).select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM h WHERE matched >= 2")
def bm25_at_least_two(spark, sf):
    return S.bm25(table(spark, sf, "documents"), TERMS).where("matched >= 2").select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT lang, COUNT(*) AS hits, round(MAX(score), 6) AS best FROM h JOIN len USING (doc_id) WHERE score >= 0.5 GROUP BY lang")
def bm25_facets(spark, sf):
    docs = table(spark, sf, "documents")
    h = S.bm25(docs, TERMS).where("score >= 0.5").join(docs.select("doc_id", "lang"), "doc_id")
    return h.groupBy("lang").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 6).alias("best"))


_POST = f"WITH {_TOK}, p AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL) "


@query(_POST + "SELECT term, COUNT(*) AS df, SUM(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_frequencies(spark, sf):
    return S.term_stats(table(spark, sf, "documents"))


@query(_POST + "SELECT term, COUNT(*) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 25")
def top_terms(spark, sf):
    return S.term_stats(table(spark, sf, "documents")).select("term", "df").orderBy(F.desc("df"), "term").limit(25)


@query(f"WITH {_TOK} SELECT COUNT(*) AS n_docs, SUM(len(w))::BIGINT AS n_tokens, round(AVG(len(w)), 6) AS avg_len FROM tok")
def index_stats(spark, sf):
    n = F.size(T.tokens(F.col("text")))
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avg_len"))


@query(_POST + ", d AS (SELECT term, COUNT(*) AS df FROM p GROUP BY term), n AS (SELECT COUNT(*) AS n FROM documents) SELECT doc_id, COUNT(*) AS terms, round(SQRT(SUM(pow(tf * ln((1 + n) / (1.0::DOUBLE + df)), 2))), 4) AS norm FROM p JOIN d USING (term), n GROUP BY doc_id")
def tfidf_norms(spark, sf):
    """Postings are formed inside each text's row. Document frequencies are a table: where it is small, postings meet it
    without a shuffle, and a row a text is left of them before one.
    """
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    posts = T.own_postings(docs)
    df = kept(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    x = posts.join(df, "term").join(F.broadcast(n))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sqrt(F.sum(F.pow(F.col("tf") * F.log((1 + F.col("n")) / (1.0 + F.col("df"))), 2))), 4).alias("norm"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) >= 5)) AS long_words, length(text) AS n, sha256(text) AS cid FROM documents")
def content_ids(spark, sf):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.char_length(x) >= 5)
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("long_words"), F.char_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("cid"))


@query("SELECT cid, COUNT(*) AS copies, MIN(doc_id) AS first_id FROM (SELECT sha256(text) AS cid, doc_id FROM documents) GROUP BY cid HAVING COUNT(*) > 1")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("cid"), "doc_id")
    return d.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, i AS chunk, substr(text, i * 900 + 1, 1000) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 1000, 100)).alias("chunk", "body")).withColumn("chunk", F.col("chunk").cast("long"))


@query(r"SELECT doc_id, COUNT(*) AS sentences, MAX(length(s)) AS longest FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\s*')) AS s FROM documents) WHERE trim(s) <> '' GROUP BY doc_id")
def chunk_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"[.!?]+\s*")).alias("s")).where(F.trim("s") != "")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.char_length("s")).cast("long").alias("longest"))


@query(r"SELECT doc_id, i AS paragraph, length(p) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(p) <> ''")
def chunk_paragraphs(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "p")).where(F.trim("p") != "")
    return p.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.char_length("p").cast("long").alias("size"))


_C = "c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, AVG(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


def centroids(emb):
    """(label, c) by mean; one row a label."""
    each = emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


@query(f"WITH {_C} SELECT label, len(c) AS dims, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 5) AS norm, round(c[1], 5) AS first FROM c")
def centroid_by_label(spark, sf):
    c = centroids(table(spark, sf, "embeddings"))
    return c.select("label", F.size("c").cast("long").alias("dims"), F.round(V.norm(F.col("c")), 5).alias("norm"), F.round(F.col("c")[0], 5).alias("first"))


def _knn(metric_sql, order):
    return f"WITH {_C}, s AS (SELECT c.label AS query, vec_id, round({metric_sql}, 6) AS score FROM c, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score {order}, vec_id) AS rank FROM s) SELECT query, rank, vec_id, score FROM r WHERE rank <= 10"


_DOT = "list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * embedding[i]::DOUBLE))"
_N1, _N2 = "sqrt(list_sum(list_transform(c, lambda x: x * x)))", "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_L2 = "sqrt(list_sum(list_transform(range(1, len(c) + 1), lambda i: (c[i] - embedding[i]::DOUBLE) * (c[i] - embedding[i]::DOUBLE))))"


def knn(spark, sf, metric, desc=True):
    """Exact search of the labels' centroids: the query set has a row a label; each task keeps ten rows a query before the shuffle."""
    emb = table(spark, sf, "embeddings")
    s = emb.join(centroids(emb).select(F.col("label").alias("query"), "c")).select("query", "vec_id", F.round(metric(F.col("c"), F.col("embedding")), 6).alias("score"))
    w = W.partitionBy("query").orderBy(F.desc("score") if desc else F.asc("score"), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query(_knn(_DOT, "DESC"))
def knn_dot(spark, sf):
    return knn(spark, sf, V.dot)


@query(_knn(f"{_DOT} / ({_N1} * {_N2})", "DESC"))
def knn_cosine(spark, sf):
    return knn(spark, sf, V.cosine)


@query(_knn(_L2, "ASC"))
def knn_l2(spark, sf):
    return knn(spark, sf, V.l2, desc=False)


_EVERY = "q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0)"


def _batch(name, score, order="DESC", where="true", metric="cosine", k=10, least=None):
    """Registers a search of every row whose id is divisible by 100, itself left out, against all rows."""

    def f(spark, sf):
        e = table(spark, sf, "embeddings")
        return S.nearest(e.where(where), e.where("vec_id % 100 = 0"), metric, k, least)

    f.__name__ = name
    s = f"WITH {_EVERY}, s AS (SELECT query, vec_id, round({score}, 6) AS score FROM q, embeddings WHERE vec_id <> query AND {where})"
    if k is None:
        query(f"{s} SELECT query, vec_id, score FROM s WHERE score >= {least}")(f)
    else:
        query(f"{s}, r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score {order}, vec_id) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= {k}")(f)


_batch("knn_batch", "list_cosine_similarity(q, embedding::DOUBLE[])")
_batch("knn_batch_dot", "list_inner_product(q, embedding::DOUBLE[])", metric="dot")
_batch("knn_batch_l2", "list_distance(q, embedding::DOUBLE[])", order="ASC", metric="l2")
_batch("knn_batch_filtered", "list_cosine_similarity(q, embedding::DOUBLE[])", where="label IN (1, 2)")
_batch("knn_batch_min_score", "list_cosine_similarity(q, embedding::DOUBLE[])", k=None, least=0.2)


@query(f"WITH {_C} SELECT CAST(floor(round({_DOT} / ({_N1} * {_N2}), 6) * 10) AS BIGINT) AS bucket, COUNT(*) AS n FROM c, embeddings e WHERE e.label = c.label GROUP BY 1")
def score_histogram(spark, sf):
    emb = table(spark, sf, "embeddings")
    s = emb.join(centroids(emb), "label").select(F.floor(F.round(V.cosine(F.col("c"), F.col("embedding")), 6) * 10).alias("bucket"))
    return s.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(list_sum(e) / len(e), 6) AS mean, round(list_max(e), 6) AS hi, round(list_min(e), 6) AS lo, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2, round(list_sum(list_transform(e, lambda x: abs(x))), 6) AS l1 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def vector_stats(spark, sf):
    e = V.doubles(F.col("embedding"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    r = table(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    return r.select("vec_id", F.round(add(F.col("e")) / F.size("e"), 6).alias("mean"), F.round(F.array_max("e"), 6).alias("hi"), F.round(F.array_min("e"), 6).alias("lo"), F.round(V.norm(F.col("e")), 6).alias("l2"), F.round(add(F.transform("e", F.abs)), 6).alias("l1"))


_LISTS = """l AS (SELECT 'size' AS source, doc_id, length(text)::DOUBLE AS score FROM documents WHERE length(text) > 1000
UNION ALL SELECT 'words', doc_id, len(string_split(text, ' '))::DOUBLE FROM documents WHERE lang = 'en'
UNION ALL SELECT 'lines', doc_id, len(string_split(text, chr(10)))::DOUBLE FROM documents WHERE length(text) < 3000),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER (PARTITION BY source) AS n, MIN(score) OVER (PARTITION BY source) AS lo, MAX(score) OVER (PARTITION BY source) AS hi FROM l) """


def lists(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where(F.char_length("text") > 1000).select(F.lit("size").alias("source"), "doc_id", F.char_length("text").cast("double").alias("score"))
    b = d.where("lang = 'en'").select(F.lit("words").alias("source"), "doc_id", F.size(F.split("text", " ")).cast("double").alias("score"))
    return a.union(b).union(d.where(F.char_length("text") < 3000).select(F.lit("lines").alias("source"), "doc_id", F.size(F.split("text", "\n")).cast("double").alias("score")))


def _fusion(name, sql, **how):
    def f(spark, sf):
        return S.fuse(lists(spark, sf), **how).select("doc_id", F.round("fused", 6).alias("fused"))

    f.__name__ = name
    query(f"WITH {_LISTS} SELECT doc_id, round({sql}, 6) AS fused FROM r GROUP BY doc_id")(f)


_fusion("fusion_rrf", "SUM(1.0::DOUBLE / (60 + rank))", how="rrf")
_fusion("fusion_borda", "SUM(n - rank + 1)::DOUBLE", how="borda")
_fusion("fusion_combsum", "SUM(score)", how="combsum")
_fusion("fusion_combmnz", "SUM(score) * COUNT(*)", how="combmnz")
_fusion("fusion_combmax", "MAX(score)", how="combmax")
_UNIT = "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0::DOUBLE END"
_fusion("fusion_minmax", f"SUM({_UNIT})", how="minmax")
_fusion("fusion_weighted", f"SUM({_UNIT} * CASE source WHEN 'size' THEN 2.0::DOUBLE WHEN 'lines' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)", how="weighted", weights={"size": 2.0, "lines": 0.5})


@query()
def mmr_rerank(spark, sf):
    emb = table(spark, sf, "embeddings")
    top = knn(spark, sf, V.cosine).select(F.col("query").cast("long").alias("query_id"), F.col("vec_id").alias("id"), "score")
    return S.mmr(top.join(emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id"), 5)


@query()
def mmr_batch(spark, sf):
    """The ten found for each query of knn_batch, reranked."""
    e = table(spark, sf, "embeddings")
    top = S.nearest(e, e.where("vec_id % 100 = 0")).select(F.col("query").alias("query_id"), F.col("vec_id").alias("id"), "score")
    return S.mmr(top.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id"), 5)


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, COALESCE(quality, 0) AS rel FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT lang, SUM(rel) AS total FROM r GROUP BY lang),
i AS (SELECT lang, SUM(1.0::DOUBLE / (ln(g + 1) / ln(2.0::DOUBLE))) AS ideal FROM t, LATERAL (SELECT unnest(range(1, 11)) AS g) WHERE g <= total GROUP BY lang)
SELECT lang, round(SUM(rel) / 10.0::DOUBLE, 6) AS p_at_10, round(SUM(rel) / MAX(total)::DOUBLE, 6) AS r_at_10, round(SUM(rel / (ln(rank + 1) / ln(2.0::DOUBLE))) / MAX(ideal), 6) AS ndcg, round(MAX(rel / rank::DOUBLE), 6) AS mrr FROM r JOIN t USING (lang) JOIN i USING (lang) WHERE rank <= 10 GROUP BY lang""")
def search_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("rel", F.coalesce("quality", F.lit(0)))
    top = d.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10")
    t = d.groupBy("lang").agg(F.sum("rel").alias("total")).where("total > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, g: s + 1 / F.log2(g + 1.0))
    g = top.join(t, "lang").groupBy("lang", "total").agg(F.sum("rel").alias("hit"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.max(F.col("rel") / F.col("rank")).alias("mrr"))
    return g.select("lang", F.round(F.col("hit") / 10.0, 6).alias("p_at_10"), F.round(F.col("hit") / F.col("total"), 6).alias("r_at_10"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))
