"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has 20 symbols of 16 bits. Documents of similarity 0.8 differ in 4 symbols on average, and in more than 11
once in ten thousand pairs; 11 is the distance threshold. In four chunks of 5 symbols, a pair within it has a chunk with at
most 2 errors, so it agrees on some 3 symbols of that chunk: each document is filed under the 10 triples of each of its 4
chunks, which are whole keys, not hashes. Candidates must be within the signature distance, and the parities of their
shingles over 1,024 cells may not differ in more cells than the sets may in shingles, which loses no pair; what is left is
compared on full sets.

Documents with equal sets form a class and appear as its smallest id only, so copies by the thousand cost nothing.

Defined results: a null or wordless text has no shingles and no links; of rows that repeat an id with other texts, the one
with the smallest hash of its set stands for the id, and all of them get its component and their own n_shingles; a row with
a null id is kept, with a null component, and linked with nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bits_of, flagged, likely, slices, table
from .links import link

SYMBOLS, CHUNKS, ERRORS, DISTANCE = 20, 4, 2, 11
#: Symbols to a 64-bit lane, whose top bits stay free; cells of the parity sketch; rows worked off at once.
LANES, CELLS, ROWS = 3, 1_024, 1_024
SALTS = 16

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SEED, _ODD = _rng.integers(1, 2**63, SYMBOLS, np.uint64), _rng.integers(1, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 4) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; words are folded and split by the UTF-8 bytes of the whole slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return [np.zeros(0, np.uint64)] * len(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    n = len(data)
    space = _SPACE[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[edge] |= ~space[edge]
    ends[edge - 1] |= ~space[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    power = np.full(n, _P, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
    back = np.full(n, _P_INV, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    word = _mix((total[last + 1] - total[first]) * back[first])
    bound = np.searchsorted(first, at)
    if len(word) >= size:
        run = sum(word[i : len(word) - size + 1 + i] * _STEP[i] for i in range(size))
        run = _mix(run)
    out = []
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _STEP[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, n, h1, h2, sig, cells): the set's size, two 64-bit hashes of the whole set, its signature, three symbols to
    a number, and the parities of its shingles over CELLS cells. No shuffle."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets])
        some = np.flatnonzero(n)
        h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        sig = np.zeros((len(n), -(-SYMBOLS // LANES)), np.int64)
        cells = np.zeros((len(n), CELLS // 64), np.int64)
        if len(some):
            flat, start = np.concatenate([sets[i] for i in some]), np.cumsum(n[some]) - n[some]
            h1[some] = np.add.reduceat(_mix(flat + np.uint64(1)), start).view(np.int64)
            h2[some] = np.add.reduceat(_mix(flat ^ _P), start).view(np.int64)
            for k in range(SYMBOLS):
                least = _mix(np.minimum.reduceat((flat ^ _SEED[k]) * _ODD[k], start)) >> np.uint64(48)
                sig[some, k // LANES] |= least.view(np.int64) << (16 * (k % LANES))
            at = np.repeat(some, n[some]) * CELLS + (flat & np.uint64(CELLS - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(n) * CELLS) & 1).astype(np.uint8)
            cells = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(n), -1)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (sig, cells)]
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1), pa.array(h2), *lists], ["doc_id", "n", "h1", "h2", "sig", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for at in range(0, len(part), ROWS):
                    some = part.slice(at, ROWS)
                    yield made(some.column(0), shingle_sets(some.column(1), size))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig array<long>, cells array<long>")


def sets(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, h1, set): the sorted shingle hashes of each text, and the hash of the whole set as in signatures()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = shingle_sets(part.column(1), size)
                h1 = [int(_mix(s + np.uint64(1)).sum().view(np.int64)) if len(s) else 0 for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["doc_id", "h1", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, set array<long>")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id): 48 bits of three symbols under the number of their chunk and places."""
    width = SYMBOLS // CHUNKS
    symbol = [F.shiftrightunsigned(F.col("sig")[k // LANES], 16 * (k % LANES)).bitwiseAND(F.lit(0xFFFF)) for k in range(SYMBOLS)]
    keys, n = [], 0
    for c in range(CHUNKS):
        for places in combinations(range(width), width - ERRORS):
            key = F.lit(n << 48).cast("long")
            for i, p in enumerate(places):
                key = key.bitwiseOR(F.shiftleft(symbol[c * width + p], 16 * i))
            keys.append(key)
            n += 1
    return classes.select(F.explode(F.array(*keys)).alias("key"), F.col("rep").alias("id"))


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes a.n and b.n may be alike: by size, by the symbols that differ and by the parities that differ."""
    low, high = sum(0x7FFF << 16 * i for i in range(LANES)), sum(0x8000 << 16 * i for i in range(LANES))
    apart = " + ".join(f"bit_count(((((({a}.sig[{k}] ^ {b}.sig[{k}]) & {low}) + {low}) | ({a}.sig[{k}] ^ {b}.sig[{k}])) & {high}))" for k in range(-(-SYMBOLS // LANES)))
    cells = " + ".join(f"bit_count({a}.cells[{k}] ^ {b}.cells[{k}])" for k in range(CELLS // 64))
    size = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
    return F.expr(f"{size} AND {apart} <= {DISTANCE} AND {100 + percent} * ({cells}) <= {100 - percent} * ({a}.n + {b}.n)")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text), linked at Jaccard >= percent / 100."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text")
    own = scratch.table(signatures(docs, size), "own")
    repeated = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("h1", "h2", "n")).alias("first")).where("rows > 1")
    repeated = scratch.table(repeated, "repeated")
    once = repeated.isEmpty()
    if not once:
        # One row stands for its id: all of the id's rows take its hashes, and only that one's signature takes part.
        first = repeated.select(F.col("doc_id").alias("__id"), "first")
        own = own.withColumn("size", F.col("n")).join(first, F.col("doc_id") == F.col("__id"), "left").drop("__id")
        stands = (F.col("first").isNull() | ((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2")))).alias("stands")
        own = own.select("doc_id", *[F.coalesce(F.col(f"first.{c}"), F.col(c)).alias(c) for c in ("n", "h1", "h2")], "sig", "cells", "size", stands)
    else:
        own = own.select("*", F.col("n").alias("size"), F.lit(True).alias("stands"))
    classes = own.where("n > 0 AND doc_id IS NOT NULL AND stands").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("sig").alias("sig"), F.first("cells").alias("cells"))
    classes = scratch.table(classes, "classes")
    full: list[DataFrame] = []

    def items(ids: DataFrame) -> DataFrame:
        bits = scratch.table(bits_of(ids, "id"), "bits")
        found = sets(likely(docs, "doc_id", bits), size)
        if not once:
            found = found.join(classes.select(F.col("rep").alias("doc_id"), "h1"), ["doc_id", "h1"], "left_semi").dropDuplicates(["doc_id"])
        full.append(scratch.table(found.select(F.col("doc_id").alias("id"), "set"), "sets"))
        return likely(classes, "rep", bits).select(F.col("rep").alias("id"), F.struct("n", "sig", "cells").alias("p"))

    def confirm(pairs: DataFrame) -> DataFrame:
        some = likely(full[0], "id", scratch.table(bits_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"), "bits"))
        a, b = (some.select(F.col("id").alias(x), F.col("set").alias(f"set{x}")) for x in "ab")
        both, n = F.size(F.array_intersect("seta", "setb")), F.size("seta") + F.size("setb")
        return pairs.join(b, "b").join(a, "a").where((100 + percent) * both >= percent * n).select(pairs.columns)

    comp = link(scratch, index_keys(classes), items, lambda a, b: alike(a, b, percent), confirm=confirm)
    scratch.drop(*full)
    placed = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    # Rows meet their class's component by the set's hashes; only classes with news for a row take part, salted.
    news = placed.where("members > 1 OR component_id <> rep").select(*[F.col(c).alias(f"__{c}") for c in ("n", "h1", "h2")], "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    rows = own.drop("sig", "cells", "stands").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = [F.col(c) == F.col(f"__{c}") for c in ("n", "h1", "h2", "salt")]
    out = rows.join(news, same[0] & same[1] & same[2] & same[3] & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: rows whose id isn't its component's leave, and repeated rows of an id.

    Texts aren't shuffled: most rows pass by a set of the ids that leave, and only those that it may hold meet them.
    """
    scratch = Scratch(docs.sparkSession, "oneofeach")
    found = scratch.table(near_duplicates(docs, scratch=scratch, **how), "found")
    scratch.keep_only(found)
    gone = scratch.table(found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    marked = flagged(docs, "doc_id", scratch.table(bits_of(gone, "__id"), "bits"), "__leaves")
    doubtful = marked.where("__leaves").join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    left = marked.where("NOT __leaves").unionByName(doubtful).drop("__leaves")
    if found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id IS NULL"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
