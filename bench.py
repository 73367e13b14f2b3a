"""Headline-query benchmark.

Runs a fixed set of registered queries over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row is
computed, nothing is collected to the driver).  A short warm-up on the
smallest scale factor runs first so JIT / codegen start-up is not billed to
the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "run_statistics",          # flagship: pairs -> ROUGE/BLEU/LCS -> combined -> per-run stats
    "bleu_corpus",
    "best_worst",
    "clean_attrition",
    "history_holdout_split",
    "task_aware_metrics",
    "mask_deterministic",
    "batch_requests",
    "imitation_prompts",
    "ngram_perplexity",
    "condition_describe",
    "rm_anova",
    "kde_grid",
    "integrity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("EVALFRAME_MASTER", f"local[{cpus}]")
    from evalframe.session import get_session
    from evalframe import plans

    spark = get_session(master=f"local[{cpus}]", app="evalframe-bench", shuffle_partitions=max(8, 2 * cpus))
    qs = plans.queries()
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("run_statistics", "clean_attrition", "mask_deterministic"):
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
