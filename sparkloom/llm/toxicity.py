"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding, normalised by length, with exceptions.

Folding lower-cases and maps homoglyphs, full-width letters and digit substitutions to plain letters; i, l, 1 and | become
one letter. The lexicon is learned from labelled documents: words, and stems that begin several words of a document, that
are in far more of the toxic ones, weighted by log-odds, kept only if they help to explain toxic documents that the words before them don't already (a word that merely
stands in copies of a toxic document is explained by that document's real ones, and always follows the same word). Exception phrases are pairs of words with
a lexicon word that occur mainly in clean documents; they cancel the match inside them. The score is a logistic function
of the total weight and of the weight per hundred words.

Defined results: a null or empty text has no matches and gets the score of such a text; without labels of both kinds, or
words that tell them apart, the lexicon is empty and every score is 0; a text without a match scores under a half; a null id is not held out; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, held_out, slices, table

#: Bounds: labelled documents learned from, and entries of the lexicon and of its exceptions.
TRAIN_DOCS, MAX_TERMS, MAX_EXCEPTIONS = 20_000, 2_000, 2_000

# Letters of other scripts that look like Latin ones, and usual substitutions.
_LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ε": "e", "ı": "i"}
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "|": "i", "l": "i"}
_FOLD = {ord(k): v for k, v in (_LOOK_ALIKE | _SUBSTITUTES).items()} | {0xFEE0 + c: _SUBSTITUTES.get(chr(c).lower(), chr(c).lower()) for c in range(0x30, 0x7B) if chr(c).isalnum()}
#: Between letters only, as they also end and decorate words.
_INNER = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
_MARKS = {"@": "a", "$": "s", "!": "i"}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _INNER.sub(lambda m: _MARKS[m[0]], text)
    return text.translate(_FOLD)


@dataclass
class Model:
    """terms: folded word, or stem with * -> weight; exceptions: folded phrases; coef: of 1, log(1 + weight), log(1 + weight per 100 words)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, float, float] | None = None

    def matcher(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, w in self.terms.items() | {(e, -sum(self.terms.get(w, 0.0) for w in e.split(" "))) for e in self.exceptions}:
            stem = k.rstrip("*")
            a.add_word(stem, (len(stem), w, k))
        a.make_automaton()
        return a


def matches(text: str, automaton: ahocorasick.Automaton) -> tuple[float, list[tuple[int, str]]]:
    """The weight found in a folded text, and the matches (position, entry); an exception's weight is negative.

    A word or phrase counts where it stands whole. A stem (its entry ends in *) counts at the beginning of longer words,
    from the second on: once may be chance.
    """
    if not len(automaton):
        return 0.0, []
    weight, found, n = 0.0, [], len(text)
    stems: dict[str, int] = {}
    for end, (size, w, entry) in automaton.iter(text):
        start = end - size + 1
        if start and text[start - 1].isalpha():
            continue
        longer = end + 1 < n and text[end + 1].isalpha()
        if entry[-1] == "*":
            if longer:
                seen = stems[entry] = stems.get(entry, 0) + 1
                if seen > 1:
                    weight += w
                    found.append((start, entry))
        elif not longer:
            weight += w
            found.append((start, entry))
    return max(0.0, weight), found


def entries(text: str) -> set[str]:
    """A folded text's words, and stems of 4 to 8 letters with which two or more of its words begin."""
    words = _WORD.findall(text)
    stems = Counter(w[:k] for w in words for k in range(4, 9) if len(w) > k)
    return {*words, *(f"{k}*" for k, n in stems.items() if n > 1)}


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    folded = fold(text)
    weight, _ = matches(folded, automaton)
    return (math.log1p(weight), math.log1p(100 * weight / max(1, text.count(" ") + text.count("\n") + 1))) if weight else (0.0, 0.0)


def probability(x: np.ndarray, coef: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coef[0] + x @ np.array(coef[1:]), -30, 30)))


def chance(x: tuple[float, float], coef: tuple[float, float, float] | None) -> float:
    """The score of a text's features; without a match, whatever the share of toxic labels, under a half."""
    if coef is None:
        return 0.0
    p = float(probability(np.array([x]), coef)[0])
    return p if x[0] else min(p, 0.49)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Newton's method on the bounded sample's two features."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.array([0.0, 1.0, 1.0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def _counted(sample: DataFrame, per_text, schema: str) -> DataFrame:
    """Counts of per_text's strings over clean and toxic texts: added up per batch, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = (Counter(), Counter())
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n[toxic].update(per_text(fold(text or "")))
                terms = [*n[0].keys() | n[1].keys()]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([n[i][t] for t in terms], pa.int64()) for i in (0, 1))], ["term", "clean", "toxic"])

    return sample.select("text", "toxic").mapInArrow(run, schema).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _explaining(candidates: list[tuple[str, float]], toxic_docs: list[dict[str, str]], least: float) -> dict[str, float]:
    """Candidates, most telling first, that still explain documents: each entry found before in a document halves its say.

    toxic_docs: for each, its candidates and the word before each. Documents with the same word before a candidate count
    once, so that copies of one document don't lend support to whatever rare words stand in it. Of entries of which one
    begins with the other, the first is kept.
    """
    holding = defaultdict(dict)
    for i, words in enumerate(toxic_docs):
        for w, left in words.items():
            holding[w].setdefault(left, i)
    say, kept = np.ones(len(toxic_docs)), {}
    for term, weight in candidates:
        stem = term.rstrip("*")
        if any(stem.startswith(k.rstrip("*")) and k[-1] == "*" or term[-1] == "*" and k.startswith(stem) for k in kept):
            continue
        if say[[*holding[term].values()]].sum() >= least:
            kept[term] = weight
            say[[i for i, words in enumerate(toxic_docs) if term in words]] /= 2
    return kept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_most: int = TRAIN_DOCS, min_docs: int = 3, min_odds: float = 2.5) -> Model:
    """A model from labels (id, toxic) and their documents.

    At most about `at_most` labelled documents are learned from, chosen by the hash of their ids; their ids, so bounded,
    are broadcast to the scan of the documents.
    """
    chosen = hash_sample(labels.where(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["__id"]), "__id", at_most)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("text", "toxic").persist()
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        sample.unpersist()
        return Model()
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    words = _counted(sample, entries, "term string, clean long, toxic long")
    # The likelihood ratio of presence in toxic documents against presence at the common rate.
    rate = (F.col("toxic") + F.col("clean")) / float(n[0] + n[1])
    gain = F.col("toxic") * F.log(F.col("toxic") / n[1] / rate) + (n[1] - F.col("toxic")) * F.log(F.greatest(1 - F.col("toxic") / n[1], F.lit(1e-9)) / F.greatest(1 - rate, F.lit(1e-9)))
    rows = words.where(F.length("term").between(3, 40) & (F.col("toxic") >= min_docs) & (odds >= min_odds)).select("term", odds.alias("odds")).orderBy(F.desc(gain), "term").limit(MAX_TERMS).collect()
    candidates = [(r["term"], r["odds"]) for r in rows]
    names = {c[0] for c in candidates}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                w = _WORD.findall(fold(t or ""))
                left = {f"{b[:k]}*": a for a, b in zip(["", *w], w, strict=False) for k in range(4, min(9, len(b)))} | dict(zip(w, ["", *w], strict=False))
                rows.append([(x, left[x]) for x in sorted(names & entries(fold(t or "")))])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], ["words"])

    toxic_docs = [r["words"] for r in sample.where("toxic = 1").select("text").mapInArrow(held, "words map<string,string>").collect()]
    terms = _explaining(candidates, toxic_docs, max(min_docs / 2, 0.015 * n[1]))

    def pairs(text: str) -> set[str]:
        w = _WORD.findall(text)
        return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if (a in terms or b in terms) and f"{a} {b}" in text}

    if not terms:
        sample.unpersist()
        return Model()
    rows = _counted(sample, pairs, "term string, clean long, toxic long").where("clean >= 5 AND clean >= 4 * toxic").orderBy(F.desc("clean"), "term").limit(MAX_EXCEPTIONS).collect()
    model = Model(terms, [r["term"] for r in rows])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            x = [features(t or "", automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(1)], ["a", "b", "toxic"])

    data = sample.mapInArrow(measured, "a double, b double, toxic int").toPandas()
    sample.unpersist()
    model.coef = _logistic(data[["a", "b"]].to_numpy(), data["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, hits) of every text, in one pass without a shuffle; the broadcast model is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.matcher()
        for batch in batches:
            for part in slices(batch, "text"):
                s, hits = [], []
                for text in part.column(1).to_pylist():
                    folded = fold(text or "")
                    weight, found = matches(folded, automaton)
                    x = (math.log1p(weight), math.log1p(100 * weight / max(1, folded.count(" ") + folded.count("\n") + 1)))
                    s.append(chance(x, model.coef))
                    hits.append(len(found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32()), pa.array(hits, pa.int64())], ["doc_id", "score", "predicted", "hits"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, score double, predicted int, hits long")


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """The model from the labels outside the held-out fold."""
    return train(docs if docs is not None else table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic, by the same matching, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.matcher()
        for batch in batches:
            for part in slices(batch, "text"):
                keep = [chance(features(t or "", automaton), model.coef) < 0.5 for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(spark, sf_dir, docs))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "hits")
