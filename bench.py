"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  An untimed warm-up pass runs
every query once on the smallest test tables ($BENCH_WARMUP_DIR, default the
sibling ``sf0.001`` folder; ``none`` to skip), so the timed pass measures a
warm JVM, as in a long-running service, not class loading and JIT.  With
$BENCH_RUNS above 1 the median of the runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from trendlens.plans.catalog import QUERIES
    from trendlens.session import local_session

    spark = local_session(
        cpus,
        app="trendlens-bench",
        **{"spark.sql.shuffle.partitions": str(max(cpus, 8)), "spark.driver.memory": "16g"},
    )
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    selected = [n for n in QUERIES if not only or n in only]
    if warm_dir != "none" and os.path.isdir(warm_dir):
        for name in selected:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        warm_dir = "none"
        QUERIES["top_topics_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        taken = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "n_queries": len(times),
                "warmup": os.path.basename(warm_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
