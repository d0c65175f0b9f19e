"""The corpus pipeline: toxicity, line dedup, near-dup, mixing, packing, each stage over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import linededup, mixing, neardup, packing, toxicity
from sparkloom.llm.common import Scratch

#: The stages sample by hash and learn from labels, and packing cuts and fills bins, which SQL can't express.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic leave; labels outside the held-out fold, whose documents are still there, are learned from.

    A null or empty text, a null id and repeated rows stay; without labels of both kinds all stay.
    """
    return toxicity.without_toxic(docs, toxicity.trained(spark, sf_dir, docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike lines only the first stays; documents stay, even without a line left.

    Rows equal in id and text keep the same lines; a null text stays null; n_chars follows the text.
    """
    return linededup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies have a Jaccard similarity of 0.8 on runs of five words; four are op2_near_dup's own.

    Of each group the row with the smallest id stays, and one row of a repeated id; rows with a null id and texts without
    words stay.
    """
    return neardup.one_of_each(docs, size=5)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and the hash of its id say; null sources are one source, null ids hash alike."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's token ids with the sequence and offset that they lie at; a null text is the end id alone."""
    return packing.pack_documents(spark, docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near-dup", near_dup_stage), ("mix", mix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads its predecessor's table, which is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.table(stage(spark, docs, sf_dir), name)
        kept.keep_only(docs)
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    kept.keep_only()
    return out
