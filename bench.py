"""Headline queries on local cores: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores,
BENCH_QUERIES (comma-separated, or "all") the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairn.plans.queries import QUERIES  # noqa: E402
from cairn.session import local_session, run_folder  # noqa: E402

HEADLINE = [
    "status_summary",
    "score_questionnaire",
    "score_stroop",
    "profile_blended",
    "trend_fit",
    "latest_vs_previous",
    "history_entries",
    "band_distribution",
    "assessment_asof_session",
    "fold_task_state",
    "toggle_task",
    "delete_task_cascade",
    "reconstruct_sessions",
    "auto_cycle_chains",
    "message_corpus",
    "stream_daily_activity",
]


def run_once(spark, name: str, folder: str) -> float:
    """Seconds for the whole result, computed but not kept; what it wrote on the way is removed."""
    with run_folder(spark):
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began


def main() -> None:
    """Warm each query once, then take the median of the runs."""
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cairn-bench")
    seconds = {}
    for name in names:
        run_once(spark, name, folder)
        timed = sorted(run_once(spark, name, folder) for _ in range(runs))
        seconds[name] = round(timed[len(timed) // 2], 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
