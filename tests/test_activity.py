"""Counters, weeks and streaks."""

import pytest

from cairn.operators import activity
from tests.helpers import DAILY, TASKS, at, day, rows

EVENTS = "user_id bigint, ts timestamp_ntz, kind string, duration_minutes int"


def daily(spark, *days, user=1):
    return spark.createDataFrame([(user, day(d), n, m) for d, n, m in days], DAILY)


def test_counters_count_events(spark):
    data = [
        (1, at("2024-01-10", "09:00:00"), "focus", 10),
        (1, at("2024-01-10", "23:59:59"), "focus", 15),
        (1, at("2024-01-10", "10:00:00"), "complete", None),
        (1, at("2024-01-10", "10:01:00"), "complete", None),
        (1, at("2024-01-10", "10:02:00"), "reopen", None),
        (1, at("2024-01-11", "00:00:00"), "complete", None),
        (2, at("2024-01-11", "00:00:00"), "activate", None),
    ]
    found = activity.daily_activity(spark.createDataFrame(data, EVENTS))
    assert rows(found) == [(1, day("2024-01-10"), 2, 25), (1, day("2024-01-11"), 1, 0)]


def test_unknown_day_is_zero(spark):
    log = daily(spark, ("2024-01-10", 2, 25))
    found = activity.daily_log_on(log, log, ["2024-01-10", "2024-01-12"])
    assert rows(found) == [(1, day("2024-01-10"), 2, 25), (1, day("2024-01-12"), 0, 0)]


@pytest.mark.parametrize(
    "as_of,expected",
    [
        ("2024-01-10", [(1, 3)]),  # today counts
        ("2024-01-11", [(1, 3)]),  # the day before is enough
        ("2024-01-12", []),  # a gap ends it
        ("2024-01-06", [(1, 1)]),  # later days are ignored
        ("2024-01-05", []),
    ],
)
def test_streak(spark, as_of, expected):
    log = daily(
        spark, ("2024-01-06", 1, 0), ("2024-01-07", 0, 30), ("2024-01-08", 1, 0),
        ("2024-01-09", 2, 0), ("2024-01-10", 1, 0),
    )
    assert rows(activity.streak_days(log, as_of)) == expected
    summary = activity.counters(log, as_of).first()
    assert summary.streak_days == (expected[0][1] if expected else 0)


def test_islands(spark):
    log = daily(spark, ("2023-12-31", 1, 0), ("2024-01-01", 1, 0), ("2024-01-03", 1, 0))
    assert rows(activity.streak_islands(log), "first_day", "days") == [
        (day("2023-12-31"), 2), (day("2024-01-03"), 1)
    ]


@pytest.mark.parametrize("as_of,total", [("2024-01-07", 7), ("2024-01-08", 4), ("2024-01-14", 4)])
def test_week_starts_on_monday_and_has_no_end(spark, as_of, total):
    # The 7th is a Sunday, the 8th a Monday; the 20th lies ahead and still counts.
    log = daily(
        spark, ("2023-12-31", 100, 0), ("2024-01-01", 1, 0), ("2024-01-07", 2, 0),
        ("2024-01-08", 1, 0), ("2024-01-20", 3, 0),
    )
    assert rows(activity.week_totals(log, as_of), "week_tasks_completed") == [(total,)]
    assert activity.counters(log, as_of).first().week_tasks == total


def test_status_and_progress(spark):
    log = daily(spark, ("2024-01-10", 1, 25))
    tasks = spark.createDataFrame(
        [
            (1, 1, "a", None, "pending", at("2024-01-02"), None),
            (1, 2, "b", None, "active", at("2024-01-03"), None),
            (1, 3, "c", None, "active", at("2024-01-01"), None),
            (2, 4, "d", None, "done", at("2024-01-01"), at("2024-01-02")),
        ],
        TASKS,
    )
    found = activity.with_progress(activity.status_summary(log, tasks, "2024-01-10"))
    assert rows(found) == [
        (1, 1, 25, 1, 25, 1, 1, 2, 0, 3, 1, 25.0),
        (2, 0, 0, 0, 0, 0, 0, 0, 1, None, None, 0.0),
    ]


def test_streak_never_exceeds_active_days(stand):
    from pyspark.sql import functions as F

    days = activity.active_days(stand.daily).groupBy("user_id").agg(F.count("*").alias("n"))
    streaks = activity.streak_days(stand.daily, "2024-01-30")
    assert streaks.join(days, "user_id").filter("streak_days > n").isEmpty()


def test_rollup_levels_agree(stand):
    from pyspark.sql import functions as F

    rolled = activity.activity_rollup(stand.daily)
    sums = rolled.groupBy("level").agg(F.sum("focus_minutes")).collect()
    assert len(sums) == 3 and len({r[1] for r in sums}) == 1


def test_status_lists_inside_the_row(spark):
    """The oldest open tasks of each kind, of a user with very many too; empty lists where there are none."""
    from cairn.operators.activity import status_view
    from tests.helpers import DAILY, TASKS, at, day

    data = [(1, i, f"t{i}", None, "pending", at("2024-01-01", f"00:{59 - i % 60:02d}:00"), None) for i in range(400)]
    data += [(2, 1000, "b", 7, "active", at("2024-01-02"), None), (2, 999, "a", None, "active", at("2024-01-02"), None),
             (3, 5, "d", None, "done", at("2024-01-02"), None)]
    tasks = spark.createDataFrame(data, TASKS).repartition(4)
    daily = spark.createDataFrame([(4, day("2024-01-30"), 1, 5)], DAILY)
    view = status_view(daily, tasks, "2024-01-30", n=3)
    got = {r.user_id: ([x.id for x in r.pending], [(x.id, x.parent_id) for x in r.active], r.pending_tasks) for r in view.collect()}
    assert got == {1: ([59, 119, 179], [], 400), 2: ([], [(999, None), (1000, 7)], 0), 3: ([], [], 0), 4: ([], [], 0)}
    assert "WindowGroupLimit" in view._jdf.queryExecution().executedPlan().toString()
