"""Headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lintlake.catalog import registry
from lintlake.session import build_session

HEADLINE = [
    "language_histogram", "file_stats", "scan_filter_extended", "secrets", "weak_crypto", "sql_injection", "perf_loops", "todo_comments",
    "magic_numbers", "commented_code", "long_functions_brace", "deep_nesting", "duplicate_blocks", "unused_variables",
    "findings_dedup", "findings_basic", "finding_ids", "code_context", "repo_report", "repo_report_basic", "dir_rollup", "dead_files", "stream_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.lintlake.read.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    registry.QUERIES["language_histogram"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            t = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
