"""Language identification by a mixture model over each document's words.

Training counts character trigrams, hashed into a fixed number of buckets, per language, on a bounded sample of labelled
documents, and leaves a table of log-probabilities of bounded size. For a document, every word has a likelihood under each
language (the product of its trigrams'); expectation-maximisation finds the proportions of languages that make its words
likeliest. Of all learned languages, those are then dropped, least proportion first, whose loss doesn't lower the penalised
likelihood (log-likelihood minus `penalty` * languages * log(words) / 2). Where there are many, several go at once if that
costs no more likelihood than the penalty of a single one, so that each of them would go by itself too. The prediction is
the language with the largest proportion left; all that are left are listed.

Defined results: `und` and score 0 where the text is null or has no letters, or where there was nothing to learn from;
repeated rows give repeated rows; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, held_out, slices, table

BUCKETS = 1 << 15
#: The bound of the training sample, in documents.
TRAIN_DOCS = 20_000
_SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams centred on each letter; each word's first trigram; the text of each word. Words are runs of letters."""
    joined = "\n" + "\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _letters()[c]
    c[~letter] = _SPACE
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D) >> np.uint32(17)) % np.uint32(BUCKETS)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, first, np.searchsorted(ends, at[first], "left")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", at_most: int = TRAIN_DOCS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of shape (BUCKETS, languages), from labelled documents.

    Counts are added up per batch, then by Spark; what comes to the driver has at most BUCKETS rows a language.
    """
    sample = hash_sample(docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", at_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column(1).to_pylist()
                names = sorted(set(langs))
                h, first, doc = trigrams([(t or "").lower() for t in part.column(0).to_pylist()])
                code = np.array([names.index(x) for x in langs])[doc]
                key = np.repeat(code, np.diff([*first, len(h)])) * BUCKETS + h if len(h) else np.zeros(0, int)
                n = np.bincount(key, minlength=len(names) * BUCKETS)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some // BUCKETS], pa.string()), pa.array(some % BUCKETS), pa.array(n[some])], ["lang", "bucket", "n"])

    rows = sample.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(names)), 0.5)
    counts[rows["bucket"], [names.index(x) for x in rows["lang"]]] += rows["n"]
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _mixture(lik: np.ndarray, start: np.ndarray, words: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document after some rounds. lik: (words, languages), scaled per word."""
    doc = np.repeat(np.arange(len(start)), words)
    for i in range(rounds + 1):
        joint = lik * pi[doc]
        total = joint.sum(1) + 1e-30
        if i == rounds:
            return pi, np.add.reduceat(np.log(total), start)
        joint /= total[:, None]
        pi = np.add.reduceat(joint, start, axis=0) / words[:, None]
    raise AssertionError


def proportions(texts: list[str], logp: np.ndarray, penalty: float = 2.0, rounds: int = 5) -> np.ndarray:
    """(texts, languages): the proportions left after selection; zeros for texts without letters."""
    out = np.zeros((len(texts), logp.shape[1]))
    h, first, doc = trigrams([t.lower() for t in texts])
    if not len(first) or not logp.shape[1]:
        return out
    score = np.add.reduceat(logp[h], first, axis=0)
    lik = np.exp(score - score.max(1, keepdims=True))
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    which, words = doc[start], np.diff([*start, len(doc)])
    many = lik.shape[1]
    pi, ll = _mixture(lik, start, words, np.full((len(start), many), 1.0 / many, np.float32), rounds)
    size = (pi > 0).sum(1)
    drop = np.maximum(size // 4, 1)
    open_ = np.flatnonzero(size > 1)
    while len(open_):
        if len(open_) < len(start):
            mine = np.zeros(len(start), bool)
            mine[open_] = True
            part, n = lik[np.repeat(mine, words)], words[open_]
        else:
            part, n = lik, words
        now = pi[open_]
        place = np.argsort(np.argsort(np.where(now > 0, now, np.inf), axis=1, kind="stable"), axis=1)
        fewer = np.where(place < drop[open_, None], 0, now)
        fewer, ll2 = _mixture(part, np.cumsum(n) - n, n, fewer / np.maximum(fewer.sum(1, keepdims=True), 1e-30), 3)
        better = ll2 + penalty * np.log(n + 1) / 2 >= ll[open_]
        shut = ~better & (drop[open_] == 1)
        won = open_[better]
        pi[won], ll[won] = fewer[better], ll2[better]
        size = (pi > 0).sum(1)
        lost = open_[~better]
        drop[lost] //= 2
        drop[won] = np.minimum(drop[won], size[won] // 4)
        drop = np.maximum(drop, 1)
        open_ = open_[~shut & (size[open_] > 1)]
    out[which] = pi
    return out


def identify(docs: DataFrame, names: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs): langs lists the selected languages with their proportions, largest first.

    One pass without a shuffle; the broadcast table has BUCKETS rows and a column for each language.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = model.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = proportions([t or "" for t in part.column(1).to_pylist()], logp)
                order = np.argsort(-p, axis=1, kind="stable") if len(names) else np.zeros((len(p), 0), int)
                langs = [[(names[j], float(row[j])) for j in o if row[j] > 0] for row, o in zip(p, order, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0][0] if x else "und" for x in langs], pa.string()), pa.array([min(1.0, x[0][1]) if x else 0.0 for x in langs], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x] for x in langs], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    ["doc_id", "lang_pred", "score", "langs"],
                )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, logp = train(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, names, logp).withColumn("held_out", held_out("doc_id", 4, 2))
