"""Operators that SQL can't say, against brute force; the others on nulls, ties, empty tables and cycles."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import strings, text
from sparkloom.operators import graph, learning, rerank, rules, temporal, textual, vectorial
from sparkloom.plans import learning as learning_plans
from sparkloom.sources import archives


def test_lcs(spark):
    rows = [(1, "a b c d e".split(), "x b d e".split()), (2, [], ["a"]), (3, ["a"], []), (4, list("abcbdab"), list("bdcaba")), (5, ["q"], ["q"])]
    got = {r.i: r.n for r in spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select("i", strings.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert got == {i: brute(a, b) for i, a, b in rows}


def pack(sentences, most, overlap):
    done, now = [], []
    for s in sentences:
        if not now or len(" ".join([*now, s])) <= most:
            now.append(s)
            continue
        done.append(" ".join(now))
        tail = now[-overlap:] if overlap else []
        now = [*tail, s] if len(" ".join([*tail, s])) <= most else [s]
    return [*done, " ".join(now)] if now else done


def join_small(chunks, least):
    done, held = [], ""
    for c in chunks:
        held = f"{held} {c}" if held else c
        if len(held) >= least:
            done.append(held)
            held = ""
    if held and done:
        done[-1] = f"{done[-1]} {held}"
    elif held:
        done = [held]
    return done


def test_packed_and_merged(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["w" * int(n) for n in rng.integers(1, 30, k)]) for i, k in enumerate([0, 1, 5, 40, 90])]
    df = spark.createDataFrame(rows, "i int, s array<string>")
    got = df.select("i", textual.packed(F.col("s"), 50, 1).alias("a"), textual.packed(F.col("s"), 50).alias("b"), textual.merged(F.col("s"), 20).alias("c")).collect()
    for r, (_, s) in zip(sorted(got), rows, strict=True):
        assert (r.a, r.b, r.c) == (pack(s, 50, 1), pack(s, 50, 0), join_small(s, 20))


def test_content_chunks(spark):
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, 60_000)))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, "inserted " + long), (6, "é" * 5000)]
    got = textual.content_chunks(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    for i, t in rows:
        data, own = (t or "").encode(), sorted((r for r in got if r.id == i), key=lambda r: r.chunk)
        assert [r.start for r in own] == [0, *np.cumsum([r.size for r in own])[:-1]] if own else not data
        assert sum(r.size for r in own) == len(data) and all(r.size <= 4096 for r in own) and all(r.size >= 256 for r in own[:-1])
        assert all(zlib.crc32(data[r.start : r.start + r.size]) == r.crc for r in own)
    four, five = ({r.crc for r in got if r.id == i} for i in (4, 5))
    assert len(four & five) > 0.7 * len(four)


def test_text_rank(spark):
    s = ["the cat sat on the mat", "the cat lay on the mat", "dogs bark", "a cat on a mat"]
    sets = [set(x.split()) for x in s]
    sim = np.array([[0 if i == j else len(a & b) / (np.log(len(a) + 1) + np.log(len(b) + 1)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    share = np.divide(sim, sim.sum(0), out=np.zeros_like(sim), where=sim.sum(0) > 0)
    r = np.full(4, 0.25)
    for _ in range(30):
        r = 0.15 / 4 + 0.85 * share @ r
    got = spark.createDataFrame([(s,), ([],)], "s array<string>").select(textual.text_rank(F.col("s")).alias("r")).collect()
    assert got[0].r == pytest.approx(r.tolist()) and got[1].r == []


def test_checksums_and_lookups(spark, sf):
    from sparkloom.plans import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in QUERIES["checksums"](spark, sf).collect())


@pytest.fixture(scope="module")
def points(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]


def test_principal_axes(spark, sf, points):
    x, ids = points
    mean, axes = vectorial.principal_axes(spark.read.parquet(f"{sf}/embeddings.parquet"), 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0), atol=1e-9) and np.allclose(np.abs((axes * vt[:3]).sum(1)), 1, atol=1e-6)


def test_product_quantiser(spark, sf, points):
    x, ids = points
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = x[:16].reshape(16, 8, 8).transpose(1, 0, 2)
    books = vectorial.lloyd(e, first, 3)
    want = first.copy()
    for _ in range(3):
        for p in range(8):
            at = vectorial.assigned(x[:, 8 * p : 8 * p + 8], want[p])
            want[p] = [x[at == c, 8 * p : 8 * p + 8].mean(0) if (at == c).any() else want[p, c] for c in range(16)]
    assert np.allclose(books, want, atol=1e-9)
    codes = {r.vec_id: r.codes for r in vectorial.product_codes(e, books).collect()}
    got = {r.vec_id: r.d for r in vectorial.product_codes(e, books).select("vec_id", vectorial.asymmetric(F.col("codes"), x[0], books).alias("d")).collect()}
    for i, v in zip(ids, x, strict=True):
        near = [int(np.round(((v[8 * p : 8 * p + 8] - books[p]) ** 2).sum(1), 9).argmin()) for p in range(8)]
        assert codes[i] == near
        assert got[i] == pytest.approx(np.sqrt(sum(((x[0][8 * p : 8 * p + 8] - books[p][c]) ** 2).sum() for p, c in enumerate(near))))
    none = e.limit(0)
    assert np.allclose(vectorial.lloyd(none, first, 1), first) and vectorial.product_codes(none, books).count() == 0


def test_hierarchy():
    x = np.array([[0.0], [1.0], [5.0], [5.5], [20.0]])
    n = np.ones(5)
    assert [(a, b) for a, b, _ in vectorial.hierarchy(x, n, "single")] == [(2, 3), (0, 1), (0, 2), (0, 4)]
    assert [d for *_, d in vectorial.hierarchy(x, n, "single")] == [0.5, 1.0, 4.0, 14.5]
    assert [d for *_, d in vectorial.hierarchy(x, n, "complete")] == [0.5, 1.0, 5.5, 20.0]
    assert [round(d, 6) for *_, d in vectorial.hierarchy(x, n, "average")] == [0.5, 1.0, 4.75, 17.125]
    # Ward: the root of twice the growth of the sum of squares halves to this for single points.
    assert [round(d, 4) for *_, d in vectorial.hierarchy(x, n, "ward")][:2] == [round(0.5 / np.sqrt(2), 4), round(1 / np.sqrt(2), 4)]


@pytest.mark.parametrize("how", ["perceptron", "passive_aggressive", "sgd_momentum"])
def test_online(spark, how):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = np.where(x @ [1.0, -2.0] + 0.3 > 0, 1, -1)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(99, 1.0, 1.0, None, 0)], "id long, a double, b double, y int, batch int")
    got = learning.online(df, ["a", "b"], "y", how)
    w, v, z = np.zeros(3), np.zeros(3), np.column_stack([x, np.ones(60)])
    for k in range(3):
        part, label = z[k::3], y[k::3]
        s = part @ w
        step = {"perceptron": np.where(label * s <= 0, label, 0), "passive_aggressive": label * np.minimum(1, np.maximum(0, 1 - label * s) / (part**2).sum(1)), "sgd_momentum": label / (1 + np.exp(label * s))}[how]
        g = (step[:, None] * part).mean(0)
        v = 0.9 * v + 0.1 * g if how == "sgd_momentum" else g
        w = w + v
    assert np.allclose(got, w)


def test_learners_learn(spark, sf):
    truth = {r.id: r.returned for r in learning_plans.returns(spark, sf).select("id", "returned").distinct().collect()}
    from sparkloom.plans import QUERIES

    for name in ("tree_gini", "tree_entropy", "forest", "boosted_trees"):
        rows = QUERIES[name](spark, sf).collect()
        assert sum(truth[r.id] == r.predicted for r in rows) / len(rows) > 0.8, name  # some ids occur twice


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (None,), (b"a",), (b"x" * 1000,)], "data binary")
    files = archives.write_car(df, f"file://{tmp_path}/car", rows=2)
    files = spark.createDataFrame(files.collect(), files.schema)
    back = sorted(bytes(r.data) for r in archives.read_car(files, f"file://{tmp_path}/car").collect())
    assert back == sorted([b"a", b"", b"a", b"x" * 1000])
    t = spark.createDataFrame([("n", [1.0, 2.5]), ("m", []), (None, [1.0]), ("o", None)], "name string, values array<float>")
    files = archives.write_safetensors(t, f"file://{tmp_path}/st")
    files = spark.createDataFrame(files.collect(), files.schema)
    assert {(r.name, tuple(r["values"])) for r in archives.read_safetensors(files, f"file://{tmp_path}/st").collect()} == {("n", (1.0, 2.5)), ("m", ())}
    assert archives.write_ipc(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_overlaps_with_ties_and_empty_spans(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 30, 80), rng.integers(0, 6, 80), strict=True))]
    got = {r.id: r.others for r in temporal.overlap_counts(spark.createDataFrame(rows, "id long, k int, s long, e long"), "k").collect()}
    assert got == {i: sum(1 for j, q, a, b in rows if q == k and j != i and a <= e and s <= b) for i, k, s, e in rows}
    assert temporal.overlap_counts(spark.createDataFrame([], "id long, k int, s long, e long"), "k").count() == 0


def test_rules_and_blending(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "i int, x int")
    r = {q.i: (q.a, q.b) for q in df.select("i", rules.first_match([("small", F.col("x") < 10), ("any", F.col("x").isNotNull())], "none").alias("a"), rules.all_matches([("small", F.col("x") < 10), ("any", F.col("x").isNotNull())]).alias("b")).collect()}
    assert r == {1: ("small", ["small", "any"]), 2: ("none", []), 3: ("any", ["any"])}
    d, s = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, score double"), spark.createDataFrame([(2, 1.0), (3, 3.0)], "doc_id long, score double")
    assert {x.doc_id: x.score for x in rerank.blend(d, s, 0.5).collect()} == {1: 0.5, 2: 0.5, 3: 0.5}
    assert rerank.blend(d.limit(0), s.limit(0), 0.5).count() == 0


def test_graphs_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src long, dst long")
    assert {(r.src, r.dst) for r in graph.closure(e).where("src = dst").collect()} == {(i, i) for i in (1, 2, 3, 5)}
    assert {r.id: r.level for r in graph.levels(e).collect()} == {6: 0, 7: 1}
    cost = graph.least_costs(e.selectExpr("src", "dst", "2L AS w"), spark.range(1, 2))
    assert {r.id: r.cost for r in cost.collect()} == {1: 0, 2: 2, 3: 4, 4: 6}
    assert graph.closure(e.limit(0)).count() == 0


def test_chunks_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "é" * 25)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", text.fixed_chunks(F.col("t"), 10, 2).alias("c")).collect()}
    assert got[3] == ["abc"] and got[4] == ["é" * 10, "é" * 10, "é" * 9] and got[2] == [] and not got[1]
