"""Models of vectors whose state is bounded by dimensions and clusters: moments, principal axes, k-means, product codes, LOF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .search import nearest


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    v = batch.column(1)
    keep = pc.equal(pc.list_value_length(v), dims)
    return v.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def dimensions(vectors: DataFrame) -> int:
    """The length of most vectors."""
    return vectors.where("embedding IS NOT NULL").agg(F.mode(F.size("embedding"), True).alias("d")).first()["d"] or 0


def second_moments(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of (vec_id, embedding): sums per task, of dims squared numbers each, added on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch, dims)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    parts = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInArrow(run, "n long, s array<double>, ss array<double>")
    n, s = parts.agg(F.sum("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)])).first()
    each = parts.select(F.posexplode("ss").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    mean = np.array(s) / max(n or 0, 1)
    return n or 0, mean, each.reshape(dims, dims) / max(n or 0, 1) - np.outer(mean, mean)


def principal_axes(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k axes of largest variance, as rows; the largest coordinate of each is positive."""
    dims = dimensions(vectors)
    _, mean, cov = second_moments(vectors, dims)
    value, axis = np.linalg.eigh(cov)
    axis = axis[:, np.argsort(-value, kind="stable")[:k]].T
    return mean, axis * np.sign(axis[np.arange(len(axis)), np.abs(axis).argmax(1)])[:, None]


def project(vector: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """A vector's coordinates on axes: the bounded model stands in the plan as literals."""
    centred = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    dot = lambda a: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in a]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(a) for a in axes])


def lloyd(vectors: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Centres (parts, k, width) after some rounds of k-means in each of `parts` equal slices of the vectors.

    Every round is one pass of partial sums; a centre that no vector is nearest to stays. With one part it is plain k-means,
    with several the training of a product quantiser.
    """
    parts, k, width = first.shape
    centres = first

    def step(centres: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, n = np.zeros((parts, k, width)), np.zeros((parts, k))
            for batch in batches:
                x = _matrix(batch, parts * width).reshape(-1, parts, width)
                for p in range(parts):
                    at = assigned(x[:, p], centres[p])
                    np.add.at(s[p], at, x[:, p])
                    n[p] += np.bincount(at, minlength=k)
            rows = np.concatenate([s, n[:, :, None]], 2).reshape(parts * k, width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts * k), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["c", "s"])

        sums = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInArrow(run, "c int, s array<double>")
        rows = sums.groupBy("c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width + 1)]).toPandas().sort_values("c").to_numpy()[:, 1:]
        rows = rows.reshape(parts, k, width + 1) if len(rows) else np.zeros((parts, k, width + 1))
        n = rows[..., -1:]
        return np.where(n > 0, rows[..., :-1] / np.maximum(n, 1), centres)

    for _ in range(rounds):
        centres = step(centres)
    return centres


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, the first of equally near ones."""
    return np.round((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 9).argmin(1)


def product_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, codes): of each slice of a vector the place of its nearest centre in that slice's book."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pc.equal(pc.list_value_length(batch.column(1)), parts * width)
            x = _matrix(batch, parts * width).reshape(-1, parts, width)
            codes = np.stack([assigned(x[:, p], books[p]) for p in range(parts)], 1) if len(x) else np.zeros((0, parts), int)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(codes.tolist(), pa.list_(pa.int32()))], ["vec_id", "codes"])

    return vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInArrow(run, "vec_id long, codes array<int>")


def asymmetric(codes: Column, query: np.ndarray, books: np.ndarray) -> Column:
    """The distance of a query to a coded vector: one looked-up number a slice, from a table of slices times centres."""
    parts, k, width = books.shape
    table = ((books - query.reshape(parts, 1, width)) ** 2).sum(2)
    look = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    return F.sqrt(F.aggregate(F.transform(codes, lambda c, p: look[p][c]), F.lit(0.0), lambda s, x: s + x))


def outlier_factors(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, lof): how much sparser it is around a query than around its k neighbours, exactly.

    Three rounds of neighbours: of the queries, of those, and of those again, each a blocked search against all rows. A row
    is asked once, in the first round that needs it, and what is found is a table. The last round asks nearly all rows where
    queries are many, so products grow with the square of the table by nature; what a task holds doesn't.
    """
    def ids(n: DataFrame) -> DataFrame:
        return n.select("vec_id").distinct()

    def asked(wanted: DataFrame, *before: DataFrame) -> DataFrame:
        for n in before:
            wanted = wanted.join(n.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_anti")
        q = kept(rows.join(wanted, "vec_id", "left_semi"), "asked")
        return kept(nearest(rows, q, "l2", k), "near")

    first = kept(nearest(rows, queries, "l2", k), "near")
    more = asked(ids(first), first)
    second = first.unionByName(more).join(ids(first).withColumnRenamed("vec_id", "query"), "query", "left_semi")
    far = first.unionByName(more).unionByName(asked(ids(second).union(ids(first)).distinct(), first, more))
    far = far.groupBy(F.col("query").alias("vec_id")).agg(F.max("score").alias("k_distance"))

    def density(n: DataFrame) -> DataFrame:
        d = n.join(far, "vec_id").withColumn("reach", F.greatest("score", "k_distance"))
        return d.groupBy("query").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-12))).alias("density"))

    around = density(second).select(F.col("query").alias("vec_id"), F.col("density").alias("theirs"))
    mean = first.join(around, "vec_id").groupBy("query").agg(F.avg("theirs").alias("theirs"))
    return mean.join(density(first), "query").select("query", (F.col("theirs") / F.col("density")).alias("lof"))


def hierarchy(centres: np.ndarray, sizes: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """The merges (a, b, distance) of a few centres, nearest first, by single, complete, average or ward linkage; a < b, the
    merged cluster keeps a's number."""
    d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    alive, size, centre, out = list(range(len(centres))), sizes.astype(float).copy(), centres.astype(float).copy(), []
    if linkage == "ward":
        d = np.sqrt(size[:, None] * size[None] / (size[:, None] + size[None])) * d
    while len(alive) > 1:
        a, b = min(((i, j) for i in alive for j in alive if i < j), key=lambda p: (round(d[p], 9), p))
        out.append((a, b, float(d[a, b])))
        for c in alive:
            if c in (a, b):
                continue
            new = {"single": min(d[a, c], d[b, c]), "complete": max(d[a, c], d[b, c]), "average": (size[a] * d[a, c] + size[b] * d[b, c]) / (size[a] + size[b])}.get(linkage)
            if new is None:
                t = size[a] + size[b] + size[c]
                new = np.sqrt(((size[a] + size[c]) * d[a, c] ** 2 + (size[b] + size[c]) * d[b, c] ** 2 - size[c] * d[a, b] ** 2) / t)
            d[a, c] = d[c, a] = new
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive.remove(b)
    return out


def silhouettes(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """points with s: the silhouette by squared distances, from each cluster's size, sum and sum of squares alone.

    The clusters' table has a row each and is carried as one array; it is to be bounded by the caller.
    """
    each = points.select(cluster, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = each.groupBy(cluster, "i").agg(F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    c = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.sum("q").alias("q")).join(points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")), cluster)
    all_ = c.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "m", (F.col("q") / F.col("n")).alias("q"), "n")).alias("cs"))
    v = points.withColumn("__v", F.transform(vector, lambda x: x.cast("double"))).join(F.broadcast(all_))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    own = add(F.transform("__v", lambda x: x * x))
    far = F.transform("cs", lambda k: F.struct(k["c"].alias("c"), (own + k["q"] - 2 * add(F.zip_with("__v", k["m"], lambda x, y: x * y))).alias("d"), k["n"].alias("n")))
    v = v.withColumn("__far", far)
    mine = F.filter("__far", lambda k: k["c"] == F.col(cluster))[0]
    a = mine["d"] * mine["n"] / (mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("__far", lambda k: k["c"] != F.col(cluster)), lambda k: k["d"]))
    return v.withColumn("s", F.when(mine["n"] > 1, (b - a) / F.greatest(a, b)).otherwise(0.0)).drop("__v", "__far", "cs")
