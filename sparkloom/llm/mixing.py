"""Mixing sources to target weights, in DataFrame operations alone.

Tokens are counted per source, each source gets a target by weight (with a ceiling of `ceiling` times its own size, the
excess going to the others), and its repetition rate is target / size. A document is then taken floor(rate) times, and
once more if the hash of its id falls under the rate's fraction, so that every document's expected share is exact, no
document needs to know of another, and a rerun takes the same ones.

Defined results: a null text has size 0; null sources are one source of their own, the last; a repeated row is mixed as
its twin is; a null id hashes as an empty string; an empty table gives an empty table; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

SEED = "mix-1"
#: Sources up to which their table is broadcast.
SOURCES = 100_000


def source_targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Reached level by level, the targets are min(ceiling * size, level * weight) for the one level at which they add up.
    With the sources sorted by ceiling * size / weight, those before some point are at their ceilings; the level for each
    such point comes from running sums, and the first that no later source exceeds is the one: it is the largest of those, as levels only fall behind it. There is one row per
    source here, so the windows without keys, in one task, hold as many rows as there are sources: some millions at most.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = by.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.lit(float(ceiling)) * F.col("source_size"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("ratio", F.col("top") / F.col("w"))
    s = s.withColumn("before", F.coalesce(F.sum("top").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("level_here", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
    s = s.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(everything))
    target = F.least(F.col("top"), F.coalesce(F.col("level") * F.col("w"), F.col("top")))
    s = s.select("source", "source_size", target.alias("target"))
    return s.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def copies(docs: DataFrame, sizes: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """Every row of docs with mix_source_size, mix_target and mix_copies beside its own columns; sizes: (source, size) of each row.

    There is one row a source in what docs meet. It is counted, and broadcast up to SOURCES rows; beyond, docs are shuffled
    by source, with a hot source split by adaptive execution.
    """
    targets = Scratch(docs.sparkSession, "mix").table(source_targets(sizes, **how))
    t = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("__rate"))
    t = F.broadcast(t) if targets.count() <= SOURCES else t
    joined = docs.join(t, F.col(source_col).eqNullSafe(F.col("__source")), "inner")
    whole = F.floor("__rate")
    extra = (unit_hash(F.col(id_col), seed) < F.col("__rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).drop("__source", "__rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture: each row of docs as many times as it is taken, with its own columns, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = copies(rows, docs.select(F.col(source_col).alias("source"), words(text_col).alias("size")), "id", **how)
    out = out.where("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Scratch(spark, "mixsizes").table(table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size")))
    out = copies(docs, docs.select("source", "size"))
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))


OP6_SQL = """
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT source, source_size, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / w AS ratio FROM n),
c AS (SELECT *, COALESCE(SUM(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
  SUM(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  SUM(source_size) OVER () AS everything FROM r),
l AS (SELECT *, (1.5::DOUBLE * everything - before) / rest AS level_here FROM c),
v AS (SELECT *, MAX(CASE WHEN level_here <= ratio THEN level_here END) OVER () AS level FROM l),
t AS (SELECT source, source_size, LEAST(top, COALESCE(level * w, top)) AS target FROM v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, u.source_size, u.target,
  (floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(md5(COALESCE(d.doc_id::VARCHAR, '') || '|mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)) * d.size AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""
