"""Ordered rules, aliases and constraints over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds, in order; a rule whose condition is null doesn't hold."""
    out = F.lit(default)
    for name, holds in reversed(list(rules)):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def all_matches(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in rules]))


def resolve(mentions: DataFrame, names: DataFrame, least: float, similarity) -> DataFrame:
    """(mention_id, entity, how): by the name itself, by an alias, by the most similar name that shares the first letter, or not.

    mentions: (mention_id, text); names: (entity, name, canonical). Joins on the text settle most mentions; only the rest is
    compared, within the block of its first letter.
    """
    hit = mentions.join(names, F.col("text") == F.col("name")).groupBy("mention_id").agg(F.max(F.struct("canonical", (-F.col("entity")).alias("back"))).alias("b"))
    exact = hit.select("mention_id", (-F.col("b.back")).alias("entity"), F.when(F.col("b.canonical"), "exact").otherwise("alias").alias("how"))
    rest = mentions.join(exact, "mention_id", "left_anti")
    near = rest.join(names.where("canonical"), F.substring("text", 1, 1) == F.substring("name", 1, 1))
    near = near.withColumn("sim", similarity(F.col("text"), F.col("name"))).where(F.col("sim") >= least)
    near = near.groupBy("mention_id").agg(F.max(F.struct("sim", (-F.col("entity")).alias("back"))).alias("b")).select("mention_id", (-F.col("b.back")).alias("entity"), F.lit("fuzzy").alias("how"))
    lost = rest.join(near, "mention_id", "left_anti").select("mention_id", F.lit(None).cast("long").alias("entity"), F.lit("unresolved").alias("how"))
    return exact.unionByName(near).unionByName(lost)


def violated(constraints: DataFrame, events: DataFrame, micros: int) -> DataFrame:
    """(id, kind) of the constraints (id, kind, a, b) that their events (id, s, e) break; one with a missing event holds.

    Before and after are strict; overlapping shares a point; during lies inside; within begins at most `micros` later.
    """
    x = events.select(F.col("id").alias("a"), F.col("s").alias("as"), F.col("e").alias("ae"))
    y = events.select(F.col("id").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"))
    j = constraints.join(x, "a").join(y, "b")
    holds = {"before": F.col("ae") < F.col("bs"), "after": F.col("as") > F.col("be"), "overlapping": (F.col("as") <= F.col("be")) & (F.col("bs") <= F.col("ae")), "during": (F.col("as") >= F.col("bs")) & (F.col("ae") <= F.col("be")), "within": F.abs(F.col("bs") - F.col("as")) <= micros}
    ok = F.lit(True)
    for kind, c in holds.items():
        ok = F.when(F.col("kind") == kind, c).otherwise(ok)
    return j.where(~ok).select("id", "kind")
