"""Run every registered query against its DuckDB oracle and print the verdicts.

    python check_oracles.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
import sys
import time

from sluice.plans.compare import compare
from sluice.plans.registry import all_oracles, all_queries
from sluice.session import build_session


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = build_session()
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for key in keys or sorted(queries):
        t0 = time.time()
        if key not in oracles:
            n = queries[key](spark, sf_dir).count()
            print(json.dumps({"key": key, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            continue
        try:
            res = compare(spark, key, sf_dir, queries[key], oracles[key])
        except Exception as exc:  # report and go on with the next query
            res = {"key": key, "match": False, "error": repr(exc)[:800]}
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["match"]
        print(json.dumps(res, default=str))
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
