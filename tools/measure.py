"""Seconds, DuckDB seconds on the same SQL, and shuffled bytes of the baseline queries.

    python tools/measure.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from bench import run_once  # noqa: E402
from cairn.plans.checks import CHECKS  # noqa: E402
from cairn.session import local_session  # noqa: E402
from tools.compare import connect  # noqa: E402

BASELINE = [
    "status_summary",
    "score_questionnaire",
    "profile_blended",
    "trend_fit",
    "delete_task_cascade",
    "reconstruct_sessions",
]
# The recursive check walks one event per user and step: minutes at this size.
NO_DUCKDB = {"reconstruct_sessions"}


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def median(seconds: list[float]) -> float:
    """Middle value."""
    return sorted(seconds)[len(seconds) // 2]


def main() -> None:
    """Print one table row per query."""
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, "cairn-measure")
    db = connect(folder)
    for name in sys.argv[2:] or BASELINE:
        run_once(spark, name, folder)
        time.sleep(1)
        before = shuffled(spark)
        took = [run_once(spark, name, folder)]
        time.sleep(1)
        moved = shuffled(spark) - before
        took += [run_once(spark, name, folder) for _ in range(2)]
        other = "-"
        if name not in NO_DUCKDB:
            times = []
            for _ in range(3):
                began = time.perf_counter()
                db.execute(CHECKS[name]).fetchall()
                times.append(time.perf_counter() - began)
            other = f"{median(times):.2f}"
        print(f"| `{name}` | {median(took):.2f} | {other} | {moved:,} |", flush=True)


if __name__ == "__main__":
    main()
