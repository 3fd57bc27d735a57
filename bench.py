"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data directory, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query
after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from estatescope import build_session  # noqa: E402
from estatescope.star import all_queries  # noqa: E402

HEADLINE = {
    "database_report": "report_databases",
    "table_report": "report_tables",
    "column_report": "report_columns",
    "routine_report": "report_routines",
    "top_procedures": "load_top_sql",
    "wait_shares": "load_top_wait",
    "sequence_gap": "sequence_gap",
    "text_contains": "all_matches",
    "text_contains_before_suffix": "all_matches_before_suffix",
    "text_identifiers": "reference_tokens",
    "index_rollup": "load_index_usage",
    "object_inventory": "load_database_objects",
    "column_inventory": "load_columns",
    "or_join": "disjunctive_join",
    "size_classes": "size_buckets",
    "ordered_lists": "ordered_names",
}


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for label, name in HEADLINE.items():
        if only and label not in only:
            continue
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, path).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[label] = round(statistics.median(times[1:]), 3)
        print(label, seconds[label], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries (median of warm runs)",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
