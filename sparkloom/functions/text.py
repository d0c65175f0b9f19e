"""Text expressions: all inside the JVM."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

# The stop words of the search index.
STOP_WORDS = [
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "of", "and", "or", "but", "for",
    "with", "this", "that", "are", "was", "were", "be", "been", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should",
]


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits without stop words; null text has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop)) if stop else F.filter(words, lambda w: w != "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf): an inverted index by term, one row for each document and term."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def own_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf) as postings() has them, without a shuffle: words are sorted inside the row and their runs measured.

    Only rows that share an id are put through postings().
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = kept(d.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "again")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    w = d.join(again, same, "left_anti").select("doc_id", F.array_sort(tokens(F.col("text"))).alias("w"))
    starts = F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i))
    w = w.withColumn("at", F.filter(starts, lambda i: i.isNotNull()))
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("w")))
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.get("w", a).alias("term"), (b - a).cast("long").alias("tf")))
    own = w.where("size(w) > 0").select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.term", "r.tf")
    return own.unionByName(postings(d.join(again, same, "left_semi")))


def char_ngrams(text: Column, n: int = 3) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def fixed_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Chunks of size characters, each starting size - overlap after the one before; none for empty text.

    Cut off in one pass of a look-ahead pattern; those that would begin inside the overlap with the last one are left out.
    """
    step = size - overlap
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    return F.slice(cut, 1, F.greatest(F.ceil((F.char_length(text) - overlap) / step), F.lit(1)).cast("int"))
