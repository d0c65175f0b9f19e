"""Weighting, fingerprints, chunking and summaries of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as X


def word_rows(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, term, tf): words counted within each row before anything is shuffled by partial sums."""
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(rows: DataFrame) -> DataFrame:
    """(id, term, tf, tfidf, bm25, present): idf is ln((N + 1) / (df + 1)) + 1; N, df and the mean length come from rows."""
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = rows.groupBy("id").agg(F.sum("tf").alias("len"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))
    x = rows.join(df, "term").join(size, "id").join(F.broadcast(whole))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    bm25 = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean_len")))
    return x.select("id", "term", "tf", (F.col("tf") * idf).alias("tfidf"), bm25.alias("bm25"), F.lit(1.0).alias("present"))


def cosines(weights: DataFrame, queries: DataFrame, weight: str = "tfidf") -> DataFrame:
    """(query, id, score): cosine of each query's terms with those of every other id that shares one, by a join on terms."""
    norm = weights.groupBy("id").agg(F.sqrt(F.sum(F.col(weight) ** 2)).alias("norm"))
    w = weights.join(norm, "id").select("id", "term", (F.col(weight) / F.col("norm")).alias("w"))
    q = w.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("query"), "term", F.col("w").alias("v"))
    return q.join(w, "term").where("query <> id").groupBy("query", "id").agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def code(word: Column, part: int) -> Column:
    """32 bits of a word's MD5, as a number."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long")


def fingerprints(docs: DataFrame, id_col: str, words: Column, halves: int = 2) -> DataFrame:
    """(id, fp0, fp1, ...): SimHash of each row's words: a bit is set where more than half of the words' codes have it."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(words).alias("w"))
    each = each.select("id", *[code(F.col("w"), h).alias(f"c{h}") for h in range(halves)])
    bit = lambda h, i: F.sum(F.shiftright(F.col(f"c{h}"), i).bitwiseAND(F.lit(1)) * 2 - 1)
    sums = each.groupBy("id").agg(*[bit(h, i).alias(f"s{h}_{i}") for h in range(halves) for i in range(32)])
    fp = [sum((F.when(F.col(f"s{h}_{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)), F.lit(0).cast("long")) for h in range(halves)]
    return sums.select("id", *[x.alias(f"fp{h}") for h, x in enumerate(fp)])


def alike_fingerprints(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance) of the different fingerprints (fp0, fp1) that differ in so few of 64 bits, named by their smallest id.

    Equal ones are one class. Of four 16-bit quarters, a pair within three errors has one in common.
    """
    classes = prints.groupBy("fp0", "fp1").agg(F.min("id").alias("rep"))
    quarters = [(F.shiftright(F.col(f"fp{h}"), s).bitwiseAND(F.lit(0xFFFF)) + ((2 * h + s // 16) << 16)).alias("q") for h in (0, 1) for s in (0, 16)]
    keyed = classes.select("rep", "fp0", "fp1", F.explode(F.array(*quarters)).alias("q"))
    a, b = (keyed.select("q", F.col("rep").alias(x), F.col("fp0").alias(f"{x}0"), F.col("fp1").alias(f"{x}1")) for x in "ab")
    apart = X.hamming(F.col("a0"), F.col("b0")) + X.hamming(F.col("a1"), F.col("b1"))
    return a.join(b, "q").where("a < b").where(apart <= distance).select("a", "b", apart.alias("distance")).distinct()


def packed(sentences: Column, most: int, overlap: int = 0) -> Column:
    """Sentences joined by spaces into chunks of at most `most` characters, a longer one by itself; a chunk begins with the
    last `overlap` sentences of the one before, where they leave room."""
    def size(parts: Column) -> Column:
        return F.char_length(F.array_join(parts, " "))

    def put(s: Column, x: Column) -> Column:
        fits = (F.size(s["now"]) == 0) | (size(F.concat(s["now"], F.array(x))) <= most)
        tail = F.slice(s["now"], F.greatest(F.size(s["now"]) - overlap + 1, F.lit(1)), overlap) if overlap else F.array().cast("array<string>")
        begun = F.when(size(F.concat(tail, F.array(x))) <= most, F.concat(tail, F.array(x))).otherwise(F.array(x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).alias("done"), F.when(fits, F.concat(s["now"], F.array(x))).otherwise(begun).alias("now"))

    none = F.array().cast("array<string>")
    end = lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"])
    return F.aggregate(sentences, F.struct(none.alias("done"), none.alias("now")), put, end)


def merged(chunks: Column, least: int) -> Column:
    """Chunks under `least` characters joined to the next, the last one to the one before."""
    def put(s: Column, x: Column) -> Column:
        held = F.when(s["held"] == "", x).otherwise(F.concat_ws(" ", s["held"], x))
        full = F.char_length(held) >= least
        return F.struct(F.when(full, F.concat(s["done"], F.array(held))).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    def end(s: Column) -> Column:
        n = F.size(s["done"])
        last = F.concat(F.slice(s["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(s["done"], -1), s["held"])))
        return F.when(s["held"] == "", s["done"]).when(n > 0, last).otherwise(F.array(s["held"]))

    return F.aggregate(chunks, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held")), put, end)


def content_chunks(docs: DataFrame, id_col: str, text_col: str, mask: int = 0x3FF, least: int = 256, most: int = 4096) -> DataFrame:
    """(id, chunk, start, size, crc) of content-defined chunks of each text's UTF-8: a cut follows where a rolling hash of 16
    bytes has all of mask's bits clear, `least` bytes or more after the last cut, and after `most` bytes at the latest."""
    import zlib

    def cuts(data: bytes) -> list[int]:
        x = np.frombuffer(data, np.uint8).astype(np.uint64)
        if len(x) >= 16:
            powers = np.array([pow(0x9E3779B1, 15 - i, 2**64) for i in range(16)], np.uint64)
            h = sum(x[i : len(x) - 15 + i] * powers[i] for i in range(16))
            marks = np.flatnonzero((h >> np.uint64(24)) & np.uint64(mask) == 0) + 16
        else:
            marks = np.zeros(0, int)
        out, at = [], 0
        while at < len(data):
            i = int(np.searchsorted(marks, at + least))
            end = min(int(marks[i]) if i < len(marks) else len(data), at + most, len(data))
            out.append(end)
            at = end
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, at = (text or "").encode(), 0
                for i, end in enumerate(cuts(data)):
                    rows.append((key, i, at, end - at, zlib.crc32(data[at:end])))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["id", "chunk", "start", "size", "crc"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, chunk long, start long, size long, crc long")


def text_rank(sentences: Column, rounds: int = 30, damping: float = 0.85) -> Column:
    """The rank of each of a text's sentences, by words in common over the logarithms of their numbers of words."""

    def ranks(texts: list[str]) -> list[float]:
        sets = [set(t.lower().split()) for t in texts]
        n = len(sets)
        sim = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                base = np.log(len(sets[i]) + 1) + np.log(len(sets[j]) + 1)
                sim[i, j] = sim[j, i] = len(sets[i] & sets[j]) / base if base else 0.0
        total = sim.sum(0)
        share = np.divide(sim, total, out=np.zeros_like(sim), where=total > 0)
        r = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds):
            r = (1 - damping) / max(n, 1) + damping * share @ r
        return r.tolist()

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: ranks(list(t)))

    return run(sentences)
