"""Benchmark: every registered query on one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (full computation,
nothing collected to the driver) after an untimed warm-up pass on sf0.001.
Prints one JSON line: the total, and the seconds per query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from sluice.plans.registry import all_queries
from sluice.session import build_session


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="sluice-bench")
    queries = all_queries()
    # warm-up, untimed: every query once on the smallest data set next to the
    # target (JIT, Python workers), so no query pays the start-up of the JVM
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    errors: dict[str, str] = {}
    for key in sorted(queries):
        if only and key not in only:
            continue
        try:
            queries[key](spark, warm_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # keep benchmarking the others
            errors[key] = repr(exc)[:300]
    times: dict[str, float] = {}
    for key in sorted(queries):
        if only and key not in only:
            continue
        t0 = time.perf_counter()
        try:
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # a failing query is reported, not timed
            errors[key] = repr(exc)[:300]
            continue
        times[key] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "config": {"shuffle_partitions": 2 * cpus, "aqe": True},
        "errors": errors,
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
