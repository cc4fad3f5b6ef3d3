"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver). Before timing, the JVM is
warmed up by running the same queries once on the smallest data set
($BENCH_WARMUP_DIR, default /root/testdata/sf0.001): same plan shapes, so
code generation and JIT are done, but nothing of the measured data is cached.
Prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}

The model queries (training with early stopping + calibration + production
refit; the weekly run: one slate scored and published; scoring + publishing
every not-completed meeting; the random search)
are timed too and listed under "queries"; "value" is the total of the
non-model headline queries, "value_with_ml" the total of all. BENCH_ML=0
skips the model queries; those that do not end within $BENCH_ML_SECONDS
(default 900, for all of them) are left out. Each time goes to stderr as well.
"""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchup.plans.queries import QUERIES  # noqa: E402
from matchup.session import build_session  # noqa: E402

HEADLINE = [
    "pit_dual_join",
    "lag_week_join",
    "long_to_wide",
    "cumulative_through_week",
    "dual_lookup",
    "median_fill",
    "pair_lookup",
    "first_element",
    "feature_dataset",
    "training_matrix",
    "binary_metrics",
    "auc",
    "isotonic_fit",
    "calibrate_interp",
    "slate_sort",
    "display_columns",
    "unseen_audit",
    "publish_roundtrip",
]
ML = ["gbt_winner", "predict_week", "score_publish", "search_leaderboard"]


def _driver_memory() -> str:
    """$BENCH_DRIVER_MEMORY, else ~60 % of physical memory (at most 8g)."""
    if os.environ.get("BENCH_DRIVER_MEMORY"):
        return os.environ["BENCH_DRIVER_MEMORY"]
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return f"{max(1, min(8, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def timed(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = round(time.perf_counter() - t0, 3)
    print(f"{name}: {took}", file=sys.stderr, flush=True)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = list(HEADLINE)
    ml = ML if os.environ.get("BENCH_ML", "1") == "1" else []
    spark = build_session(
        f"local[{cpus}]", app="matchup-bench", shuffle_partitions=max(8, 2 * cpus), driver_memory=_driver_memory()
    )
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        timings[name] = timed(spark, name, sf_dir)
    # Model queries come last, in a thread each, under a budget of their own: what does not end in it is left out.
    ends = time.perf_counter() + float(os.environ.get("BENCH_ML_SECONDS", "900"))
    for name in ml:
        done = {}
        worker = threading.Thread(target=lambda n=name, d=done: d.update(s=timed(spark, n, sf_dir)), daemon=True)
        worker.start()
        worker.join(max(0.0, ends - time.perf_counter()))
        if "s" not in done:
            print(f"{name}: not within the budget", file=sys.stderr, flush=True)
            break
        timings[name] = done["s"]
    headline = round(sum(timings[n] for n in names), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": headline,
        "value_with_ml": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
    }), flush=True)
    os._exit(0)  # also with a model query still at work


if __name__ == "__main__":
    main()
