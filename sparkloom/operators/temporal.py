"""Intervals and event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970, of timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The one of Allen's thirteen relations that holds between [a0, a1] and [b0, b1]."""
    cases = [
        (a1 < b0, "before"), (a0 > b1, "after"), ((a0 == b0) & (a1 == b1), "equals"), (a1 == b0, "meets"), (a0 == b1, "met_by"),
        ((a0 == b0) & (a1 < b1), "starts"), ((a0 == b0) & (a1 > b1), "started_by"), ((a1 == b1) & (a0 > b0), "finishes"), ((a1 == b1) & (a0 < b0), "finished_by"),
        ((a0 > b0) & (a1 < b1), "during"), ((a0 < b0) & (a1 > b1), "contains"), ((a0 < b0) & (a1 < b1), "overlaps"),
    ]
    out = F.lit("overlapped_by")
    for cond, name in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_s: int = 1800) -> DataFrame:
    """events with session: a new one where more than gap_s passed since the key's event before."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    new = (micros(ts) - micros(F.lag(ts).over(w)) > gap_s * 1_000_000).cast("long")
    return events.withColumn("session", F.sum(F.coalesce(new, F.lit(0).cast("long"))).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """left with the right side's last value at or before its time, by key; of several at one time that of the largest `tie`.

    One union, sort and running last, not a range join.
    """
    cols = left.columns
    both = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__side", F.lit(1)).unionByName(right.select(key, ts, tie, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "__side", tie).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("__v", True).over(w)).where("__side = 1").select(*cols, "as_of")


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals (id, s, e) that overlap, by buckets of `width`: each pair meets in the first bucket both reach."""
    put = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "s", "e")], F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("bucket"))
    x, y = put(a, "a"), put(b, "b")
    j = x.join(y, "bucket").where("a_s <= b_e AND b_s <= a_e")
    return j.where(F.col("bucket") == F.floor(F.greatest("a_s", "b_s") / width)).drop("bucket")


def overlap_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, n, least): how many intervals (id, s, e) of b share a point with each of a, and their smallest id; whole numbers.

    What overlaps [s, e] either holds s or begins in (s, e]. Intervals are cut into aligned cells of 2^k points, some two
    for each k: b's into those that hold a point, and its starts into those that a span is cut into. Cells are counted, and
    each of a meets a few dozen of them, so no pair is formed, however many overlap.
    """
    a, b = (d.where("s <= e AND s IS NOT NULL AND e IS NOT NULL") for d in (a, b))
    longest = a.select((F.col("e") - F.col("s")).alias("d")).union(b.select(F.col("e") - F.col("s"))).agg(F.max("d")).first()[0]
    if longest is None:
        return a.select(F.col("id").alias("a_id"), F.lit(0).cast("long").alias("n"), "id").limit(0).withColumnRenamed("id", "least")
    top = int(longest + 1).bit_length()

    def cell(kind: int, k: int, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), at.cast("long").alias("at"))

    def holding(kind: int, point: Column) -> list[Column]:
        return [cell(kind, k, F.floor(point / (1 << k))) for k in range(top + 1)]

    def cut(kind: int, low: Column, high: Column) -> list[Column]:
        # [low, high) by its two ends, from small cells to large ones.
        out = []
        for k in range(top + 1):
            x, y = F.ceil(low / (1 << k)), F.floor(high / (1 << k))
            up, down = F.ceil(low / (2 << k)) * 2, F.floor(high / (2 << k)) * 2
            out.append(F.when((x < y) & (x < up), cell(kind, k, x)))
            out.append(F.when((x < y) & (down < y) & ~((x < up) & (y - 1 == x)), cell(kind, k, y - 1)))
        return out

    def rows(d: DataFrame, *cells: Column) -> DataFrame:
        return d.select("id", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("id", "c.kind", "c.k", "c.at")

    s, e = F.col("s").cast("long"), F.col("e").cast("long")
    held = rows(b, *cut(0, s, e + 1), *holding(1, s)).groupBy("kind", "k", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    asked = rows(a, *holding(0, s), *cut(1, s + 1, e + 1))
    return asked.join(held, ["kind", "k", "at"]).groupBy(F.col("id").alias("a_id")).agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def followed_by(events: DataFrame, first: str, then: str, within_s: int, key: str = "user_id") -> DataFrame:
    """(key, first_id, then_id): each `first` event whose next event of the key is `then`, no later than within_s."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    nxt = events.select(key, "event_id", "ts", "event_type", F.lead("event_id").over(w).alias("then_id"), F.lead("event_type").over(w).alias("t2"), F.lead("ts").over(w).alias("ts2"))
    ok = (F.col("event_type") == first) & (F.col("t2") == then) & (micros("ts2") - micros("ts") <= within_s * 1_000_000)
    return nxt.where(ok).select(key, F.col("event_id").alias("first_id"), "then_id")


def run_of(events: DataFrame, types: list[str], within_s: int, key: str = "user_id") -> DataFrame:
    """(key, event_id) of each event that begins an unbroken run of these types among the key's events, within_s from end to end."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    ahead = events.select(key, "event_id", "ts", *[F.lead("event_type", i).over(w).alias(f"t{i}") for i in range(len(types))], F.lead("ts", len(types) - 1).over(w).alias("last"))
    for i, kind in enumerate(types):
        ahead = ahead.where(F.col(f"t{i}") == kind)
    return ahead.where(micros("last") - micros("ts") <= within_s * 1_000_000).select(key, "event_id")


def overlap_counts(spans: DataFrame, key: str) -> DataFrame:
    """spans (id, key, s, e) with others: how many other spans of the key share a point with each.

    Those that begin by its end less those that end before its start: running counts over starts and ends, so no pair is
    formed, however many overlap.
    """
    starts = spans.select(key, F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"))
    ends = spans.select(key, F.col("e").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"))
    ask = lambda c, kind: spans.select(key, F.col(c).alias("at"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
    w = W.partitionBy(key).orderBy("at", "kind")
    begun = starts.unionByName(ask("e", 1)).withColumn("n", F.count_if(F.col("id").isNull()).over(w)).where("id IS NOT NULL").select("id", F.col("n").alias("begun"))
    over = ends.unionByName(ask("s", -1)).withColumn("n", F.count_if(F.col("id").isNull()).over(w)).where("id IS NOT NULL").select("id", F.col("n").alias("over"))
    return begun.join(over, "id").select("id", (F.col("begun") - F.col("over") - 1).alias("others"))


def run_then(events: DataFrame, kind: str, then: str, least: int, most: int, within_s: int, key: str = "user_id") -> DataFrame:
    """(key, first_id, views, then_id): unbroken runs of `least` to `most` events of a kind, whole ones, directly followed by `then`."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    o = events.select(key, "event_id", "ts", "event_type", F.row_number().over(w).alias("r"), F.row_number().over(W.partitionBy(key, "event_type").orderBy("ts", "event_id")).alias("t"), F.lead("event_type").over(w).alias("nxt"), F.lead("event_id").over(w).alias("then_id"), F.lead("ts").over(w).alias("then_ts"))
    g = o.where(F.col("event_type") == kind).groupBy(key, (F.col("r") - F.col("t")).alias("run"))
    g = g.agg(F.count(F.lit(1)).alias("views"), F.min(F.struct("r", "event_id", "ts")).alias("first"), F.max(F.struct("r", "nxt", "then_id", "then_ts")).alias("last"))
    ok = F.col("views").between(least, most) & (F.col("last.nxt") == then) & (micros(F.col("last.then_ts")) - micros(F.col("first.ts")) <= within_s * 1_000_000)
    return g.where(ok).select(key, F.col("first.event_id").alias("first_id"), "views", F.col("last.then_id").alias("then_id"))
