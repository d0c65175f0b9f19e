"""Streams in several batches, with late and repeated rows, against the batch operators."""

import datetime as dt

from sparkloom.operators import temporal
from sparkloom.streaming import patterns, windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, START + dt.timedelta(minutes=m), u, k, 1.0) for e, m, u, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    # One file a batch, in the order of their times.
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/all")
    for i in range(len(batches)):
        (f,) = glob.glob(f"{tmp_path}/in{i}/part-*.parquet")
        shutil.copy(f, f"{tmp_path}/all/{i:03d}.parquet")
        os.utime(f"{tmp_path}/all/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")


def test_patterns_across_batches(spark, tmp_path):
    batches = [[(1, 0, 7, "view"), (2, 5, 8, "view"), (3, 6, 9, "view")], [(4, 20, 7, "purchase"), (5, 21, 8, "click"), (6, 22, 8, "purchase")], [(7, 2000, 9, "purchase"), (8, 2001, 7, "view")], [(9, 2002, 7, "purchase"), (10, 2003, 7, "purchase")]]
    got = patterns.run_appended(patterns.follow(feed(spark, tmp_path, batches), "view", "purchase", 3600), f"file://{tmp_path}/out").collect()
    all_rows = spark.createDataFrame([(e, START + dt.timedelta(minutes=m), u, k, 1.0) for b in batches for e, m, u, k in b], SCHEMA)
    want = temporal.followed_by(all_rows, "view", "purchase", 3600).collect()
    assert sorted(map(tuple, got)) == sorted((r.user_id, r.first_id, r.then_id) for r in want) == [(7, 1, 4), (7, 8, 9)]


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the watermark doesn't count: its hour is closed by then."""
    batches = [[(1, 0, 1, "a"), (2, 10, 1, "a")], [(3, 600, 1, "a")], [(4, 601, 1, "a")], [(5, 30, 1, "a"), (6, 602, 1, "a")]]
    got = windows.run_to_end(windows.hourly(feed(spark, tmp_path, batches)), ["hour", "event_type"], f"file://{tmp_path}/out").collect()
    assert sorted((r.hour.hour, r.n) for r in got) == [(0, 2), (10, 3)]
