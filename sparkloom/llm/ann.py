"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more coordinate: x goes to (x / M, sqrt(1 - |x|^2 / M^2)) with M the
largest norm, a query to (q / |q|, 0). Each of the tables hashes a vector to the cells floor((a . x + b) / w) of a few
Gaussian projections. A query visits, in each table, the cells around its own in order of estimated success, least sum of
squared distances to the cell's borders first; what the tables find is merged and reranked by exact inner products.

The number of projections follows the number of vectors (about `cell` vectors to a cell); the number of probes is the least
that reaches `recall` on a bounded sample of vectors, and so depends on how the vectors lie: where neighbours are hardly
nearer than others, as among random directions of many dimensions, it comes close to visiting everything.

Equal vectors are searched as one, with its `k + 1` smallest ids, which are all that can be returned. Cells lie on shelves
by hash, full cells in blocks on several; a task compares a shelf's vectors with a part of the queries that visit it, cell by
cell, and passes on a query's best few of the whole shelf. Many visitors of a shelf are dealt out in parts. Defined results: vectors null, zero, of another length than the most
frequent one (of equally frequent ones the smallest), or holding null or non-finite components take no part, as queries or candidates; a null id takes no part; rows that
repeat an id with the same vector count once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, table

SAMPLE, TABLES, CELL, BLOCK, PROBES = 6_000, 2, 2_048, 4_096, 4_096
#: Vectors to a shelf, shelves at least, queries to a part of a shelf, queries compared at once, large cells or shelves at most.
SHELF, SHELVES, QUERIES, CHUNK, LARGE = 65_536, 16, 2_048, 32, 100_000


def projections(dim: int, tables: int, m: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, dim, m)), rng.random((tables, m))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x / top
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))])


def probes(f: np.ndarray, n: int, reach: int = 3) -> np.ndarray:
    """(queries, n, m) cells, best first. f: the query's place in units of cells. Exact: the n least sums over dimensions.

    A cell's distance in a dimension is that to its nearer border, 0 for the query's own; the n least sums of some
    dimensions, each with every shift of the next, hold the n least sums with that one.
    """
    own = np.floor(f)
    frac = f - own
    shifts = np.arange(-reach, reach + 1)
    dist = np.where(shifts < 0, frac[..., None] + (-shifts - 1), np.where(shifts > 0, shifts - frac[..., None], 0)) ** 2
    score = np.zeros((len(f), 1))
    cells = np.zeros((len(f), 1, 0), np.int64)
    for j in range(f.shape[1]):
        total = (score[:, :, None] + dist[:, None, j]).reshape(len(f), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        score = np.take_along_axis(total, best, 1)
        before = np.take_along_axis(cells, best[..., None] // len(shifts), 1)
        cells = np.concatenate([before, (own[:, None, j] + shifts[best % len(shifts)])[..., None].astype(np.int64)], axis=2)
    return cells


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """One 64-bit key of each cell: 16 bits of every coordinate while they fit, mixed beyond."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        key = key * np.uint64(0x100000001B3) + (cells[..., j].astype(np.int64) & 0xFFFF).astype(np.uint64)
    return key.view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shelf_of(keys: np.ndarray, block: np.ndarray, shelves: int) -> np.ndarray:
    return (mixed(mixed(keys).view(np.int64) + block) % np.uint64(shelves)).astype(np.int32)


def best_few(products: np.ndarray, ids: np.ndarray, few: int) -> np.ndarray:
    """Places of the `few` largest finite products; of those that tie with the last, as many with the smallest ids."""
    there = np.flatnonzero(products > -np.inf)
    if len(there) <= few:
        return there
    some = products[there]
    least = np.partition(some, len(some) - few)[len(some) - few]
    tie = there[np.abs(some - least) <= 1e-12]
    return np.concatenate([there[some > least + 1e-12], tie[np.argsort(ids[tie], kind="stable")][:few]])


def fit(sample: np.ndarray, n: int, k: int, recall: float, tables: int = TABLES, cell: int = CELL) -> dict:
    """Parameters from a bounded sample of usable vectors: probes enough for `recall` of the sample's own neighbours.

    Where PROBES of a table don't reach it, there are fewer projections, so larger cells, until they do; with four or fewer
    they are all cells within reach.
    """
    top = float(np.sqrt((sample**2).sum(1)).max())
    x = lifted(sample, top)
    q = sample[:: max(1, len(sample) // 150)][:150]
    near = np.argsort(-(q @ sample.T), axis=1)[:, : k + 1]
    own = np.column_stack([q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros(len(q))])
    for m in range(max(1, min(24, ceil(log2(max(2.0, n / cell)) / 1.6))), 0, -1):
        a, b = projections(x.shape[1], tables, m)
        width = 2 * float(np.mean([(x @ a[t]).std(0).mean() for t in range(tables)])) or 1.0
        most = min(PROBES, 7**m)
        rank = np.full(near.shape, most)
        for t in range(tables):
            home = np.floor((x @ a[t] + b[t] * width) / width).astype(np.int64)
            visited = cell_keys(probes((own @ a[t] + b[t] * width) / width, most))
            keys = cell_keys(home)[near]
            for i in range(len(q)):
                order = {c: r for r, c in reversed(list(enumerate(visited[i])))}
                rank[i] = np.minimum(rank[i], [order.get(c, most) for c in keys[i]])
        ranks = np.sort(rank.ravel())
        at = int(ranks[min(len(ranks) - 1, ceil(recall * len(ranks)))])
        if at < most or m == 1:
            break
    return {"top": top, "m": m, "tables": tables, "width": width, "probes": min(most, at + 1), "reached": float((ranks < min(most, at + 1)).mean())}


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return own.where(~bad & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.94, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which is_query (a condition on `id`) holds, its k nearest found."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    own = usable(vectors, id_col, vec_col)
    dims = own.agg(F.mode(F.size("v"), True).alias("d")).first()["d"] or 0
    own = scratch.table(own.where(F.size("v") == dims).dropDuplicates(["id", "v"]), "own")
    same = W.partitionBy("v").orderBy("id")
    groups = own.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = scratch.table(groups.withColumn("rep", F.col("ids")[0]), "groups")
    n = groups.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = np.array([r["v"] for r in hash_sample(groups.select("rep", "v"), "rep", SAMPLE).select("v").collect()] or [groups.first()["v"]])
    p = fit(sample, n, min(k, max(1, len(sample) - 1)), recall, tables)
    top = groups.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("t")).first()["t"]
    a, b = projections(dims + 1, tables, p["m"])
    width, visits = p["width"], p["probes"]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lifted(np.array(batch.column(1).to_pylist()), top)
            keys = np.stack([cell_keys(np.floor((x @ a[t] + b[t] * width) / width).astype(np.int64)) ^ (t << 60) for t in range(tables)], 1)
            rows = np.repeat(np.arange(len(x)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(batch.column(i).take(pa.array(rows)) for i in range(3))], ["key", "rep", "v", "ids"])

    filed = scratch.table(groups.select("rep", "v", "ids").mapInArrow(file, "key long, rep long, v array<double>, ids array<long>"), "filed")
    # Cells lie on shelves by hash, full cells in blocks on several: no more than LARGE cells can be over this size.
    full = max(BLOCK, n * tables // LARGE)
    large = filed.groupBy("key").count().where(F.col("count") > full).orderBy("key").collect()
    large_keys, large_blocks = np.array([r["key"] for r in large], np.int64), np.array([-(-r["count"] // full) for r in large], np.int64)
    shelves = min(LARGE, max(SHELVES, ceil(n * tables / SHELF)))

    def blocks_of(keys: np.ndarray) -> np.ndarray:
        if not len(large_keys):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(large_keys, keys), len(large_keys) - 1)
        return np.where(large_keys[at] == keys, large_blocks[at], 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            block = (mixed(rep) % blocks_of(keys).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shelf_of(keys, block, shelves)), *(batch.column(i) for i in (0, 2, 3))], ["shelf", "key", "v", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array(batch.column(1).to_pylist())
            q = np.column_stack([q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros(len(q))])
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                keys = np.concatenate([cell_keys(probes((some @ a[t] + b[t] * width) / width, visits)) ^ (t << 60) for t in range(tables)], 1)
                row, key = np.repeat(np.arange(len(some)), keys.shape[1]), keys.ravel()
                blocks = blocks_of(key)
                row, key, block = np.repeat(row, blocks), np.repeat(key, blocks), np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                shelf = shelf_of(key, block, shelves)
                order = np.lexsort((key, shelf, row))
                row, shelf, key = row[order], shelf[order], key[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(key))
                rows = pa.array(at + row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(shelf[starts]), *(batch.column(i).take(rows) for i in range(2)), lists], ["shelf", "query_id", "q", "keys"])

    queries = own.where(is_query).select("id", "v")
    asked = queries.repartition(spark.sparkContext.defaultParallelism * 2, "id").mapInArrow(visit, "shelf int, query_id long, q array<double>, keys array<long>")
    asked = scratch.table(asked, "asked")
    # A shelf meets its queries in parts of about QUERIES; there are LARGE shelves at most, so this table may be broadcast.
    loads = F.broadcast(scratch.table(asked.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")), "loads"))
    asked = asked.join(loads, "shelf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    filed = filed.mapInArrow(place, "shelf int, key long, v array<double>, ids array<long>").join(loads, "shelf")
    filed = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of each query the best few of the shelf's cells that it visits, merged over those cells."""
        found: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("key", kind="stable")
            v, ids = np.stack(right["v"].to_numpy()), right["ids"].to_numpy()
            least_id = np.array([i[0] for i in ids])
            cells, start = np.unique(right["key"].to_numpy(), return_index=True)
            end = np.append(start[1:], len(v))
            q, wanted, query = np.stack(left["q"].to_numpy()), left["keys"].to_numpy(), left["query_id"].to_numpy()
            for at in range(0, len(q), CHUNK):
                some = q[at : at + CHUNK]
                hits = [np.flatnonzero(np.isin(cells, w)) for w in wanted[at : at + CHUNK]]
                cell, row = np.concatenate(hits), np.repeat(np.arange(len(some)), [len(h) for h in hits])
                visited = np.unique(cell)
                if not len(visited):
                    continue
                member = np.concatenate([np.arange(start[c], end[c]) for c in visited])
                inner, col = np.full((len(some), len(member)), -np.inf), 0
                for c in visited:
                    rows, to = row[cell == c], col + end[c] - start[c]
                    inner[rows, col:to] = some[rows] @ v[start[c] : end[c]].T
                    col = to
                for i, products in enumerate(inner):
                    for j in best_few(products, least_id[member], k + 1):
                        found += [(query[at + i], c, products[j]) for c in ids[member[j]] if c != query[at + i]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "near"]).astype({"query_id": "int64", "vec_id": "int64", "near": "float64"})

    pairs = asked.groupBy("shelf", "part").cogroup(filed.groupBy("shelf", "part")).applyInPandas(compare, "query_id long, vec_id long, near double")
    # A vector found by several tables counts once. A few more than k go on, as the products may still differ in the last bit.
    found = W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("near").alias("near")).withColumn("r", F.row_number().over(found)).where(F.col("r") <= k + 5).select("query_id", "vec_id")
    vec = own.select(F.col("id").alias("vec_id"), "v")
    exact = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(vec, "vec_id")
    exact = exact.withColumn("score", F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).drop("q", "v")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
