"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from sparkloom.plans import QUERIES
from sparkloom.session import session

HEADLINE = ["bm25_topk", "knn_dot", "knn_cosine", "fusion_rrf", "term_frequencies", "bgp_join_4", "event_aggregate", "metric_sliding", "session_windows", "as_of_value", "overlap_join", "snapshot_diff", "datalog_ancestor", "connected_components", "feature_scaling", "chunk_sentences"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='spark-')}"}
    spark = session("bench", cores=cpus, **conf)
    QUERIES["event_aggregate"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
