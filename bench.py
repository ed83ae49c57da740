"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs twice; the second run counts, the first (with start-up and code generation) is listed too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import newclient as NC  # noqa: E402
from tidemark.session import cut, local_session, owned  # noqa: E402
from workload import catalog, panels  # noqa: E402

HEADLINE = [
    "c7_group_breakdown",
    "d10_weekly_resample",
    "flagship_naive_mase",
    "d5_end_of_day_balance",
    "r1_gated_detector_panel",
    "r2_agnostic_detector",
    "r6_habitual_residual",
    "m14_client_ridge",
    "u5_adaptive_interval",
]
REPEATS = 3


def run(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    with owned(spark):
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began


def per_client(spark, sf_dir: str) -> dict[str, float]:
    """Milliseconds per unseen client of each adaptation strategy, on prepared rows (median of ``REPEATS``).

    A strategy runs for all clients at once, so this is its time over the number of clients.
    """
    weekly = cut(panels.weekly_panel(spark, sf_dir))
    n = weekly.select("account_id").distinct().count()
    bench = NC.benchmark(weekly, n * 5 // 6, n // 7, {"random_forest": NC.SETTINGS["random_forest"]})
    table = NC.warm_start(bench, repeats=REPEATS).select("model", "median_ms").collect()
    return {r.model: round(r.median_ms, 3) for r in table}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="tidemark-bench")
    first, seconds = {}, {}
    for name in HEADLINE:
        first[name] = round(run(catalog.QUERIES[name], spark, sf_dir), 3)
        seconds[name] = round(run(catalog.QUERIES[name], spark, sf_dir), 3)
        print(name, first[name], seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run": first, "ms_per_client": per_client(spark, sf_dir),
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
