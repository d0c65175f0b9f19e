"""Patterns of events over a stream, with state a key and timers that let unfinished ones go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(events: DataFrame, first: str, then: str, within_s: int, late: str = "1 hour") -> DataFrame:
    """(user_id, first_id, then_id) of a stream: each `first` event whose user's next event is `then`, within_s later at most.

    The state of a user is the last event if it may begin a pattern. It is dropped once the watermark has passed its time.
    Rows later than the watermark are left out; within a batch rows are taken in the order of their times, and a row that is
    older than the user's last one is left out too.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at, event, open_ = state.get if state.exists else (-(2**62), -(2**62), False)
        found = []
        for us, i, kind in zip(rows["us"].tolist(), rows["event_id"].tolist(), rows["event_type"].tolist(), strict=True):
            if (us, i) < (at, event):
                continue
            if open_ and kind == then and us - at <= within_s * 1_000_000:
                found.append((key[0], event, i))
            at, event, open_ = us, i, kind == first
        state.update((at, event, open_))
        state.setTimeoutTimestamp(max(at // 1000 + within_s * 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=["user_id", "first_id", "then_id"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL AND event_id IS NOT NULL")
    timed = timed.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, first_id long, then_id long", "at long, event long, open boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run_appended(stream: DataFrame, out: str) -> DataFrame:
    """Drains an append-mode stream into `out` and reads what it gave; a batch that is repeated replaces what it wrote."""
    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows").select(stream.columns)
