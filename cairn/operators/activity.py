"""Daily counters, week totals, streaks and the per-user status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.catalogue import ACTIVE, DONE, PENDING
from cairn.functions.columns import percent, week_start

Day = dt.date | str


def day_column(day: Day) -> Column:
    """A date literal."""
    return F.lit(str(day)).cast("date")


def daily_activity(events: DataFrame) -> DataFrame:
    """Counters per user and day from ``(user_id, ts, kind, duration_minutes)``.

    Counts *events*: completing the same task twice counts twice, and neither a
    reopened nor a deleted task takes its completion back.
    """
    counted = events.filter(F.col("kind").isin("complete", "focus"))
    return counted.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("kind") == "complete").alias("tasks_completed"),
        F.coalesce(
            F.sum(F.when(F.col("kind") == "focus", F.col("duration_minutes"))), F.lit(0)
        ).cast("bigint").alias("focus_minutes"),
    )


def daily_log_on(daily: DataFrame, users: DataFrame, days: list[Day]) -> DataFrame:
    """Counters of every user on each asked day, zeros when there is no row."""
    asked = users.select("user_id").distinct().withColumn(
        "date", F.explode(F.array(*[day_column(d) for d in days]))
    )
    wanted = daily.filter(F.col("date").isin([dt.date.fromisoformat(str(d)) for d in days]))
    return asked.join(wanted, ["user_id", "date"], "left").select(
        "user_id",
        "date",
        F.coalesce("tasks_completed", F.lit(0)).alias("tasks_completed"),
        F.coalesce("focus_minutes", F.lit(0)).alias("focus_minutes"),
    )


def list_daily_logs(daily: DataFrame) -> DataFrame:
    """All counters, newest day first within each user."""
    return daily.orderBy("user_id", F.col("date").desc())


def week_totals(daily: DataFrame, as_of: Day) -> DataFrame:
    """Sums from Monday of the week of ``as_of``, with no upper bound."""
    return daily.filter(F.col("date") >= week_start(day_column(as_of))).groupBy("user_id").agg(
        F.sum("tasks_completed").alias("week_tasks_completed"),
        F.sum("focus_minutes").alias("week_focus_minutes"),
    )


def active_days(daily: DataFrame) -> DataFrame:
    """Distinct days with at least one completion: at most one row per calendar day."""
    return daily.filter(F.col("tasks_completed") > 0).select("user_id", "date").distinct()


def streak_islands(daily: DataFrame) -> DataFrame:
    """Every run of consecutive active days.

    The window is bounded by the calendar: a user has one row per day here,
    however many events there were.
    """
    order = Window.partitionBy("user_id").orderBy("date")
    runs = active_days(daily).withColumn(
        "island", F.date_sub("date", F.row_number().over(order))
    )
    return runs.groupBy("user_id", "island").agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("days"),
    ).drop("island")


def streak_days(daily: DataFrame, as_of: Day) -> DataFrame:
    """Length of the run that ends on ``as_of`` or the day before, for users that have one."""
    today = day_column(as_of)
    past = daily.filter(F.col("date") <= today)
    return streak_islands(past).filter(F.col("last_day") >= F.date_sub(today, 1)).select(
        "user_id", F.col("days").alias("streak_days")
    )


def days_in_streaks(daily: DataFrame, as_of: Day) -> DataFrame:
    """Counter rows of days whose day before was active too."""
    before = active_days(daily).select("user_id", F.date_add("date", 1).alias("date"))
    today = daily.filter((F.col("date") <= day_column(as_of)) & (F.col("tasks_completed") > 0))
    return today.join(before, ["user_id", "date"], "left_semi")


def counters(daily: DataFrame, as_of: Day) -> DataFrame:
    """Today, this week and the streak in one row per user.

    All counters come out of one aggregation over the days of each user; only
    the streak adds a window, again over one row per day.
    """
    today = day_column(as_of)
    this_week = F.col("date") >= week_start(today)
    order = Window.partitionBy("user_id").orderBy("date")
    worked = (F.col("tasks_completed") > 0) & (F.col("date") <= today)
    # Numbering only worked days: the rank stays still on the others.
    rank = F.sum(worked.cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    islands = daily.withColumn("_island", F.when(worked, F.date_sub("date", rank.cast("int"))))
    last_island = F.max(F.when(worked, F.col("date"))).over(Window.partitionBy("user_id"))
    in_last = F.col("_island") == F.max("_island").over(Window.partitionBy("user_id"))
    alive = last_island >= F.date_sub(today, 1)
    marked = islands.withColumn("_in_streak", F.coalesce(in_last & alive, F.lit(False)))
    is_today = F.col("date") == today
    return marked.groupBy("user_id").agg(
        F.sum(F.when(is_today, F.col("tasks_completed")).otherwise(0)).alias("today_tasks"),
        F.sum(F.when(is_today, F.col("focus_minutes")).otherwise(0)).alias("today_minutes"),
        F.sum(F.when(this_week, F.col("tasks_completed")).otherwise(0)).alias("week_tasks"),
        F.sum(F.when(this_week, F.col("focus_minutes")).otherwise(0)).alias("week_minutes"),
        F.count_if(F.col("_in_streak")).alias("streak_days"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per status and user, with the first active and first pending one."""
    status = F.col("status")
    seen = F.struct("created_at", "id")
    return tasks.groupBy("user_id").agg(
        F.count_if(status == PENDING).alias("pending_tasks"),
        F.count_if(status == ACTIVE).alias("active_tasks"),
        F.count_if(status == DONE).alias("done_tasks"),
        F.min(F.when(status == ACTIVE, seen)).alias("_active"),
        F.min(F.when(status == PENDING, seen)).alias("_pending"),
    ).select(
        "user_id",
        "pending_tasks",
        "active_tasks",
        "done_tasks",
        F.col("_active.id").alias("first_active_id"),
        F.col("_pending.id").alias("first_pending_id"),
    )


def status_summary(daily: DataFrame, tasks: DataFrame, as_of: Day) -> DataFrame:
    """One dashboard row per user that has tasks or activity.

    The open tasks themselves are unbounded per user, so they stay rows: see
    :func:`cairn.operators.tasks.open_task_list`.
    """
    both = counters(daily, as_of).join(task_counts(tasks), "user_id", "full")
    numbers = [
        "today_tasks", "today_minutes", "week_tasks", "week_minutes", "streak_days",
        "pending_tasks", "active_tasks", "done_tasks",
    ]
    return both.select(
        "user_id",
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in numbers],
        "first_active_id",
        "first_pending_id",
    )


def status_view(daily: DataFrame, tasks: DataFrame, as_of: Day, n: int = 20) -> DataFrame:
    """The dashboard row with its two lists inside: ``pending`` and ``active``, the ``n`` oldest tasks of each.

    A list holds structs of created_at, id, title and parent_id, oldest first; a
    user without such tasks has an empty one. Every task of the shuffle passes
    on ``n`` tasks of a user and status at most, so a user with a third of all
    tasks costs no more than any other. The whole lists are rows: see
    :func:`cairn.operators.tasks.open_task_list`.
    """
    oldest = Window.partitionBy("user_id", "status").orderBy("created_at", "id")
    some = tasks.filter(F.col("status").isin(ACTIVE, PENDING)).withColumn("_place", F.row_number().over(oldest))
    row = F.struct("created_at", "id", "title", "parent_id")
    listed = some.filter(F.col("_place") <= n).groupBy("user_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("status") == status, row))).alias(status) for status in (PENDING, ACTIVE)
    ])
    none = F.array().cast(listed.schema[PENDING].dataType)
    whole = status_summary(daily, tasks, as_of).join(listed, "user_id", "left")
    return whole.withColumns({status: F.coalesce(F.col(status), none) for status in (PENDING, ACTIVE)})


def with_progress(summary: DataFrame) -> DataFrame:
    """Today's completions as a share of them and the open tasks."""
    whole = F.col("today_tasks") + F.col("pending_tasks") + F.col("active_tasks")
    return summary.withColumn("progress_pct", percent(F.col("today_tasks"), whole))


def activity_rollup(daily: DataFrame) -> DataFrame:
    """Totals per user and week, per user, and over all."""
    weekly = daily.withColumn("week", week_start(F.col("date")))
    return weekly.rollup("user_id", "week").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("tasks_completed").alias("tasks_completed"),
        F.sum("focus_minutes").alias("focus_minutes"),
    )
