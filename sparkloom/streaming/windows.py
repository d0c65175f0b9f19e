"""Windowed counts over a stream, with watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n, total) of a batch or stream; in a stream, windows close `late` behind the newest event."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Drains an update-mode aggregation into `out` (restartable from its checkpoint) and gives each key's latest row.

    A batch writes its own partition, so that one repeated after a failure replaces what it wrote before.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    values = [c for c in stream.columns if c not in keys]
    best = rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])
    return best.select(*stream.columns)
