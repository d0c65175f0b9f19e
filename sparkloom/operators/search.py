"""Ranked retrieval: BM25, vector top-k, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import kept
from .blocks import ranks


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.5, b: float = 0.75, require_all: bool = False) -> DataFrame:
    """(doc_id, score, matched) of the documents, told apart by id, with any (or all) of the terms.

    Words are counted while they are split off, with partial sums before the shuffle: a row a document crosses it, never
    the words; the one exchange serves the statistics and the scores.
    """
    wanted = [F.lit(t.lower()) for t in dict.fromkeys(terms)]
    words = docs.select("doc_id", F.explode_outer(tokens(F.col("text"))).alias("w"))
    tf = words.groupBy("doc_id").agg(F.count("w").alias("len"), *[F.count_if(F.col("w") == t).alias(f"tf{i}") for i, t in enumerate(wanted)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    joined = tf.join(F.broadcast(stats))  # one row
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)
        matched = matched + (f > 0).cast("int")
    out = joined.select("doc_id", score.alias("score"), matched.alias("matched"))
    return out.where(F.col("matched") == len(wanted) if require_all else F.col("matched") > 0)


def top_k(hits: DataFrame, k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best hits, ties to the smaller id: a partial sort in every task, then one of k rows each."""
    return hits.orderBy(F.desc(score), id_col).limit(k)


def fuse(hits: DataFrame, how: str = "rrf", k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, fused) from (source, doc_id, score) lists by rrf, borda, combsum, combmnz, combmax, minmax or weighted.

    Lists may be of any length: bounds and counts are partial aggregates with a row a list, ranks are formed in blocks.
    """
    weight: Column = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    if how in ("rrf", "borda", "minmax", "weighted"):
        hits = kept(hits.select("source", "doc_id", "score"), "hits")
    r = ranks(hits, ["source"], "score", "doc_id") if how in ("rrf", "borda") else hits
    if how in ("borda", "minmax", "weighted"):
        r = r.join(hits.groupBy("source").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n")), "source")
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    part = {"rrf": 1 / (F.lit(k) + F.col("rank")), "borda": (F.col("n") - F.col("rank") + 1).cast("double"), "minmax": unit, "weighted": unit * weight}.get(how, F.col("score"))
    total = {"combmax": F.max("part"), "combmnz": F.sum("part") * F.count(F.lit(1))}.get(how, F.sum("part"))
    return r.withColumn("part", part).groupBy("doc_id").agg(total.alias("fused"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of every term: words and each text's distinct words are summed by term in their tasks; no posting is shuffled."""
    own = docs.select(tokens(F.col("text")).alias("w"))
    each = own.select(F.explode(F.array(F.struct(F.lit(1).alias("all"), F.col("w").alias("w")), F.struct(F.lit(0).alias("all"), F.array_distinct("w").alias("w")))).alias("e"))
    return each.select("e.all", F.explode("e.w").alias("term")).groupBy("term").agg(F.sum(1 - F.col("all")).alias("df"), F.sum("all").alias("cf"))


def mmr(candidates: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """(query_id, id, pick) from candidate lists (query_id, id, score, v) of bounded length, by maximal marginal relevance."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        v = np.stack([np.asarray(x, float) for x in pdf["v"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        best, picked = np.full(len(v), -np.inf), []
        while len(picked) < min(k, len(v)):
            value = lam * pdf["score"].to_numpy() - (1 - lam) * np.where(np.isinf(best), 0, best)
            value[picked] = -np.inf
            i = int(np.argmax(value))
            picked.append(i)
            best = np.maximum(best, v @ v[i])
        return pd.DataFrame({"query_id": pdf["query_id"][picked].to_numpy(), "id": pdf["id"][picked].to_numpy(), "pick": range(1, len(picked) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, pick long")


def nearest(rows: DataFrame, queries: DataFrame, metric: str = "cosine", k: int | None = 10, least: float | None = None, chunk: int = 32_768) -> DataFrame:
    """(query, vec_id, score) of each query's k best rows, or of all rows scored `least` at least; both (vec_id, embedding).

    Exact, by cosine, dot or l2 (smaller is better), rounded to six places, ties to the smaller id. A row isn't found by a
    query of its own id. Every row meets every query in blocks: queries are broadcast in chunks of about `chunk`, and a task
    keeps the k best of its rows for each query of a chunk, so no more than that goes into the shuffle. Null ids, null
    vectors and those with a null component take no part, and vectors of different lengths don't meet; a vector of length
    zero has cosine 0.
    """
    fit = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    rows, queries = (d.select("vec_id", "embedding").where(fit) for d in (rows, queries))
    parts = max(1, -(-queries.count() // chunk))
    out = None
    for i in range(parts):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i).toArrow()
        found = rows.mapInArrow(_nearest_of(rows.sparkSession.sparkContext.broadcast(asked), metric, k, least), "query long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if k is None:
        return out
    w = W.partitionBy("query").orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def pairs_of_members(links: DataFrame, members: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, sim), a < b, of all members (rep, id) of linked classes (a, b, sim); a class linked with itself pairs its own.

    A class is cut into blocks of about `block` ids, so a row stands for two blocks and becomes block squared pairs at most,
    however large the class; the rows are dealt out before they do.
    """
    spark = links.sparkSession
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = members.join(sizes, "rep").groupBy("rep", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list("id").alias("ids"))
    dealt = kept(dealt, "blocks")
    x, y = (dealt.select(F.col("rep").alias(c), F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
    both = links.join(x, "a").join(y, "b").where("a <> b OR block_a <= block_b")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = both.withColumn("own", F.expr("a = b AND block_a = block_b")).repartition(tasks, "a", "b", "block_a", "block_b")
    each = both.select("sim", "own", "ids_b", F.explode("ids_a").alias("p")).select("sim", "own", "p", F.explode("ids_b").alias("q")).where("NOT own OR p < q")
    return each.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "sim")


def _nearest_of(asked, metric: str, k: int | None, least: float | None):
    import numpy as np
    import pyarrow as pa

    def by_length(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        v = batch.column(1)
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        sizes, ids = v.value_lengths().to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
        if not len(ids):
            return {}
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
        return {int(n): (ids[(m := sizes == n)], flat[np.repeat(m, sizes)].reshape(m.sum(), n)) for n in np.unique(sizes)}

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def pairs(q, x, ids, xids, floor):
        """(place of the query, id, goodness) of pairs that are no worse than floor and, where k is set, may be in the block's k best."""
        if metric == "l2":
            # Squares cancel where vectors are near, so they only choose; the distances come from differences.
            qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
            good, slack = -np.sqrt(np.maximum(qq + xx - 2 * q @ x.T, 0)), 1e-6 * (1 + np.sqrt(qq.max()) + np.sqrt(xx.max()))
        else:
            good, slack = (unit(q) @ unit(x).T if metric == "cosine" else q @ x.T), 0.0
        if not slack:
            good = np.round(good, 6)
        good[ids[:, None] == xids[None, :]] = -np.inf
        if k is not None and len(xids) > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(good, len(xids) - k, axis=1)[:, len(xids) - k])
        at, col = np.nonzero((good >= (floor - 2 * slack)[:, None]) & (good > -np.inf))
        value = good[at, col]
        if slack:
            value = np.concatenate([np.zeros(0), *(-np.sqrt(((q[at[i : i + 65536]] - x[col[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(at), 65536))])
            value = np.round(value, 6)
        return at, xids[col], value

    def rows_of(query, ids, good):
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(-good if metric == "l2" else good, pa.float64())], ["query", "vec_id", "score"])

    def run(batches):
        queries = by_length(asked.value)
        worst = -np.inf if least is None else -least if metric == "l2" else least
        empty = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        # For each length and block of queries: the best so far, and what a row must reach to be among them.
        best = {(n, b): [empty, np.full(len(q[0][b : b + 1024]), worst)] for n, q in queries.items() for b in range(0, len(q[0]), 1024)}
        for batch in batches:
            for n, (xids, x) in by_length(batch).items():
                for b in range(0, len(queries[n][0]) if n in queries else 0, 1024):
                    ids, q = (a[b : b + 1024] for a in queries[n])
                    held = best[n, b]
                    for j in range(0, len(xids), 2048):
                        at, found, good = pairs(q, x[j : j + 2048], ids, xids[j : j + 2048], held[1])
                        keep = good >= worst
                        at, found, good = at[keep], found[keep], good[keep]
                        if k is None:
                            yield rows_of(ids[at], found, good)
                            continue
                        at, found, good = (np.concatenate(z) for z in zip(held[0], (at, found, good), strict=True))
                        order = np.lexsort((found, -good, at))
                        at, found, good = at[order], found[order], good[order]
                        first = np.searchsorted(at, np.arange(len(ids) + 1))
                        top = np.arange(len(at)) - first[at] < k
                        full = np.flatnonzero(np.diff(first) >= k)
                        held[1][full] = good[first[full] + k - 1]
                        held[0] = (at[top], found[top], good[top])
        if k is not None:
            for (n, b), (held, _) in best.items():
                yield rows_of(queries[n][0][b + held[0]], held[1], held[2])

    return run
