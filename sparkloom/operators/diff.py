"""Comparing, patching and merging keyed snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): Added, Removed, Modified or Unchanged, from one full outer join on the key."""
    o, n = old.select(key, F.col(value).alias("o"), F.lit(1).alias("has_o")), new.select(key, F.col(value).alias("n"), F.lit(1).alias("has_n"))
    change = F.when(F.col("has_o").isNull(), "Added").when(F.col("has_n").isNull(), "Removed").when(F.col("o").eqNullSafe(F.col("n")), "Unchanged").otherwise("Modified")
    return o.join(n, key, "full").select(key, change.alias("change"))


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of right, and of left the keys that right hasn't."""
    return right.select(*left.columns).unionByName(left.join(right.select(key), key, "left_anti"))


def apply_patch(base: DataFrame, new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with a diff's changes: Added and Modified keys take new's rows, Removed keys go, the rest stays."""
    gone = changes.where(F.col("change") != "Unchanged").select(key)
    put = changes.where(F.col("change").isin("Added", "Modified")).select(key)
    return base.join(gone, key, "left_anti").unionByName(new.join(put, key, "left_semi").select(*base.columns))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): the side that changed wins; where both changed differently, ours stays and conflict is true.

    A row that one side deleted and the other left alone goes; deleted and changed is a conflict that keeps the change.
    """
    def side(d, p):
        return d.select(key, F.struct(F.col(value).alias("v")).alias(p))

    j = side(base, "b").join(side(ours, "o"), key, "full").join(side(theirs, "t"), key, "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    conflict = ~o.eqNullSafe(t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    pick = F.when(conflict, F.coalesce(o, t)).when(o.eqNullSafe(b), t).otherwise(o)
    return j.select(key, pick.alias("p"), conflict.alias("conflict")).where("p IS NOT NULL").select(key, F.col("p.v").alias(value), "conflict")
