"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.

Each query runs alone from the Parquet inputs, with no stage tables yet (they
are deleted before each one).  The first also pays for starting the JVM and
compiling code; ``second`` is all of them from the inputs again in the warm JVM.

``value`` is the flagship's end-to-end time in the first pass.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veracity.plans.queries import REGISTRY, reset_runs  # noqa: E402
from veracity.session import get_spark  # noqa: E402

HEADLINE = ["factual_precision", "scores_all", "run_summary", "knn_exact", "knn_ivf", "passages", "bm25_top5", "lexical_answers",
            "verification_prompts", "sentence_facts"]


def run(spark, sf_dir, names):
    times, rows = {}, {}
    for name in names:
        reset_runs()
        t0 = time.perf_counter()
        rows[name] = len(REGISTRY[name](spark, sf_dir).collect())
        times[name] = round(time.perf_counter() - t0, 3)
    return times, rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    first, rows = run(spark, sf_dir, names)
    second, _ = run(spark, sf_dir, names)
    reset_runs()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "flagship_end_to_end_cold", "value": first[names[0]], "unit": "sec", "queries": first,
                      "cold_total": round(sum(first.values()), 3), "second": second,
                      "rows": rows,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
