"""The search of many queries against brute force."""

import numpy as np
import pytest

from sparkloom.operators import search
from sparkloom.plans import QUERIES


def brute(rows, queries, metric, k, least):
    out = set()
    for i, q in queries:
        if i is None or q is None or None in q:
            continue
        found = []
        for j, v in rows:
            if j is None or v is None or None in v or j == i or len(v) != len(q):
                continue
            a, b = np.array(q, float), np.array(v, float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(np.linalg.norm(a - b) if metric == "l2" else a @ b if metric == "dot" else a @ b / n if n else 0), 6)
            found.append((s if metric == "l2" else -s, j, s))
        out |= {(i, j, s) for g, j, s in (sorted(found)[:k] if k else found) if least is None or s >= least}
    return out


@pytest.mark.parametrize(("metric", "k", "least"), [("cosine", 10, None), ("dot", 3, None), ("l2", 4, None), ("cosine", None, 0.1), ("cosine", 10, 0.3)])
def test_nearest_equals_brute_force(spark, metric, k, least):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-3, 4, (2600, 4)).astype(float)  # with many ties and copies
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(2600), vectors, strict=True)]
    rows += [(5000, [0.0] * 4), (5100, None), (5200, [1.0, None, 2.0, 0.5]), (None, [1.0] * 4), (5300, [1.0, 2.0]), (5400, [2.0, 1.0]), (5500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    got = search.nearest(df, df.where("vec_id % 100 = 0"), metric, k, least, chunk=10).select("query", "vec_id", "score").collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert {(r[0], r[1], r[2] + 0.0) for r in got} == {(i, j, s + 0.0) for i, j, s in brute(rows, asked, metric, k, least)}
    assert search.nearest(df.limit(0), df.limit(0), metric, k, least).count() == 0


def test_near_vectors_keep_their_distance(spark):
    base = np.full(64, 100.0)
    rows = [(0, base.tolist())] + [(i, (base + i * 1e-5).tolist()) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.nearest(df, df.where("vec_id = 0"), "l2", 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, round(i * 8e-5, 6)) for i in range(1, 6)]


def test_every_hundredth_row_is_asked(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = {r.vec_id for r in e.where("vec_id % 100 = 0").collect()}
    assert len(asked) > 1
    for name, column, each in (("knn_batch", "query", 10), ("knn_batch_dot", "query", 10), ("knn_batch_l2", "query", 10), ("knn_batch_filtered", "query", 10), ("mmr_batch", "query_id", 5)):
        found = {r[column]: r["count"] for r in QUERIES[name](spark, sf).groupBy(column).count().collect()}
        assert found == dict.fromkeys(asked, each), name
