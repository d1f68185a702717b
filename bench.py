"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median counts. All result columns are
computed (written to a sink that keeps nothing), not only counted.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from verdictframe.plans import QUERIES
from verdictframe.session import local_session

HEADLINE = [
    "verify_math",
    "math_failure_report",
    "verify_all",
    "verify_trajectory",
    "qa_gate",
    "failure_clusters",
    "slice_all",
    "stage_metrics",
    "release_decision",
    "leak_corpus_scan",
    "allocate_quota",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "sum of median wall seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores,
        "driver_memory": spark.conf.get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
