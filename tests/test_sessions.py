"""Timer sessions, batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import activity, sessions, state
from tests.helpers import SESSIONS, TIMER, at, rows

T0 = at("2024-01-01", "10:00:00")


def log(spark, *events, user=1):
    data = []
    for i, (second, kind, *rest) in enumerate(events):
        minutes, is_break, task = (*rest, None, None, None)[:3]
        data.append((user, i, T0 + dt.timedelta(seconds=second), kind, minutes, bool(is_break), task))
    return spark.createDataFrame(data, TIMER)


def found(frame, **sizes):
    return rows(
        sessions.reconstruct_sessions(frame, **sizes),
        "start_event_id", "outcome", "elapsed_seconds", "logged_minutes",
    )


def test_runs_out(spark):
    assert found(log(spark, (0, "start", 1, False, 42))) == [(0, "completed", 60, 1)]


def test_break_stopped_after_three_seconds(spark):
    assert found(log(spark, (0, "start", 1, True), (3, "stop"))) == [(0, "stopped", 3, 0)]


def test_stop_one_second_before_the_end(spark):
    assert found(log(spark, (0, "start", 1), (59, "stop"))) == [(0, "stopped", 59, 0)]
    assert found(log(spark, (0, "start", 1), (60, "stop"))) == [(0, "completed", 60, 1)]


def test_start_while_running_is_ignored(spark):
    events = log(spark, (0, "start", 1), (30, "start", 25), (60, "start", 2), (61, "start", 5))
    assert found(events) == [(0, "completed", 60, 1), (2, "completed", 120, 2)]


def test_pause_does_not_count(spark):
    events = log(spark, (0, "start", 1), (20, "toggle"), (500, "start", 9), (1000, "toggle"), (1039, "stop"))
    assert found(events) == [(0, "stopped", 59, 0)]
    events = log(spark, (0, "start", 1), (20, "toggle"), (1000, "toggle"), (1040, "stop"))
    row = sessions.reconstruct_sessions(events).first()
    assert (row.outcome, row.ended_at) == ("completed", T0 + dt.timedelta(seconds=1040))


def test_toggle_while_idle_and_open_end(spark):
    events = log(spark, (0, "toggle"), (1, "stop"), (10, "start", 1), (40, "toggle"))
    assert found(events) == [(2, "open", 30, 0)]


def test_plans_out_of_range(spark):
    events = log(spark, (0, "start", 0), (1, "start", 121), (2, "start", None), (3, "start", 120))
    assert found(events) == [(3, "completed", 7200, 120)]


@pytest.mark.parametrize("sizes", [{"chunk_rows": 1}, {"chunk_rows": 7}, {"chunk_rows": 20, "chunk_limit": 3}])
def test_chunks_do_not_matter(spark, stand, sizes):
    whole = found(stand.timer_events, chunk_rows=100_000)
    assert found(stand.timer_events, **sizes) == whole


def test_paused_through_many_starts(spark):
    starts = [(100 + i, "start", 1) for i in range(60)]
    events = log(spark, (0, "start", 1), (10, "toggle"), *starts, (900, "toggle"), (951, "stop"))
    assert found(events, chunk_rows=3) == [(0, "completed", 60, 1)]


def brute(events):
    """The timer second by second of its events, one user."""
    out, timer = [], None
    for at_, kind, minutes, event in sorted(events, key=lambda e: (e[0], e[3])):
        if timer and timer["since"] is not None and timer["since"] + timer["left"] <= at_:
            out.append((timer["id"], "completed", timer["plan"] * 60))
            timer = None
        if kind == "start" and timer is None:
            timer = {"id": event, "plan": minutes, "left": minutes * 60, "since": at_}
        elif kind == "stop" and timer:
            left = timer["left"] - (at_ - timer["since"] if timer["since"] is not None else 0)
            out.append((timer["id"], "stopped", timer["plan"] * 60 - left))
            timer = None
        elif kind == "toggle" and timer:
            if timer["since"] is None:
                timer["since"] = at_
            else:
                timer["left"] -= at_ - timer["since"]
                timer["since"] = None
    if timer:
        done = timer["since"] is not None
        out.append((timer["id"], "completed" if done else "open", timer["plan"] * 60 - (0 if done else timer["left"])))
    return sorted(out)


def test_against_brute_force(spark):
    dice = random.Random(7)
    data, expected = [], []
    for user in range(8):
        now, events = 0, []
        for i in range(120):
            now += dice.choice([0, 5, 20, 60, 200])
            kind = dice.choice(["start", "start", "toggle", "stop"])
            minutes = dice.choice([1, 2, 5]) if kind == "start" else None
            events.append((now, kind, minutes, user * 1000 + i))
            data.append((user, user * 1000 + i, T0 + dt.timedelta(seconds=now), kind, minutes, False, None))
        expected += brute(events)
    frame = spark.createDataFrame(data, TIMER).repartition(5)
    result = sessions.reconstruct_sessions(frame, chunk_rows=9)
    assert rows(result, "start_event_id", "outcome", "elapsed_seconds") == sorted(expected)


def test_logged_focus_feeds_the_counters(spark):
    events = log(spark, (0, "start", 10, False, 42), (700, "start", 15, True), (3000, "start", 15))
    focus = sessions.logged_focus(sessions.reconstruct_sessions(events))
    assert rows(focus, "id", "task_id", "duration_minutes") == [(0, 42, 10), (2, None, 15)]
    as_events = focus.select("user_id", F.col("completed_at").alias("ts"), F.lit("focus").alias("kind"), "duration_minutes")
    assert activity.daily_activity(as_events).first().focus_minutes == 25


def test_focus_activates(spark):
    events = log(spark, (0, "start", 1, False, 42), (10, "start", 1, False, 43), (100, "start", 1, True))
    started = state.activations_from_focus(sessions.reconstruct_sessions(events))
    assert rows(started, "task_id", "kind") == [(42, "activate")]


@pytest.mark.parametrize("sizes", [{}, {"limit": 1, "chunk_rows": 2}])
def test_gaps(spark, sizes):
    data = [
        (1, i, None, m, T0 + dt.timedelta(minutes=at_))
        for i, (at_, m) in enumerate([(0, 10), (30, 15), (30, 5), (100, 1), (220, 2)])
    ] + [(2, 9, None, 7, T0)]
    found_rows = rows(
        sessions.session_gap(spark.createDataFrame(data, SESSIONS), **sizes),
        "user_id", "id", "gap_minutes", "running_minutes",
    )
    assert found_rows == [
        (1, 0, None, 10), (1, 1, 30.0, 25), (1, 2, 0.0, 30), (1, 3, 70.0, 31), (1, 4, 120.0, 33), (2, 9, None, 7)
    ]


@pytest.mark.parametrize("sizes", [{}, {"limit": 1, "chunk_rows": 2}])
def test_chains(spark, sizes):
    events = log(
        spark, (0, "start", 1, False, 42), (60, "start", 1, True), (120, "start", 1, False, 42),
        (200, "start", 1, True), (230, "stop"), (230, "start", 1, False), (400, "start", 1, False),
    )
    chains = sessions.auto_cycle_chains(sessions.reconstruct_sessions(events), 1.0, **sizes)
    assert rows(chains, "chain", "sessions", "focus_blocks", "focus_minutes", "task_id") == [
        (1, 3, 2, 2, 42), (2, 1, 0, 0, None), (3, 1, 1, 1, None), (4, 1, 1, 1, None)
    ]


@pytest.mark.parametrize("chunks,most", [(31, 8), (1000, 14)])
def test_a_timer_leaps_over_the_chunks_it_sits_through(spark, chunks, most):
    """Starts only, chunks of 8 rows, plans far longer than a chunk: few turns, the right sessions."""
    seconds = 3 * 3600 / 1000  # a chunk each
    log = spark.range(chunks * 8).select(
        F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"),
        F.timestamp_micros((F.col("id") * int(seconds / 8 * 1e6)).cast("bigint")).cast("timestamp_ntz").alias("ts"),
        F.lit("start").alias("kind"), F.lit(100).alias("planned_minutes"), F.lit(False).alias("is_break"),
        F.lit(None).cast("bigint").alias("task_id"),
    )
    folds = sessions.fold_log(log, chunk_rows=8)
    assert len(folds) <= most
    found = sessions.reconstruct_sessions(log, chunk_rows=8)
    begins = [r.start_event_id for r in found.orderBy("started_at").collect()]
    step, expected = int(seconds / 8 * 1e6), [0]
    while True:
        after = -(-(expected[-1] * step + 100 * 60 * 10**6) // step)
        if after >= chunks * 8:
            break
        expected.append(after)
    assert begins == expected


def test_turns_do_not_grow_with_the_events_of_an_instant(spark):
    """Every event 360 times at its instant: as many sessions, and hardly more turns."""
    dice = random.Random(7)
    data, now = [], 0
    for i in range(1500):
        now += dice.choice([30, 90, 240])
        kind = dice.choice(["start", "start", "start", "toggle", "stop"])
        data.append((i % 2, i * 1000, T0 + dt.timedelta(seconds=now), kind, dice.choice([5, 15, 25]), False, i))
    once = spark.createDataFrame(data, TIMER)
    copies = spark.range(360).withColumnRenamed("id", "copy")
    dense = once.filter("kind != 'toggle'").crossJoin(copies).withColumn("event_id", F.col("event_id") + F.col("copy")).drop("copy")
    dense = dense.unionByName(once.filter("kind = 'toggle'")).localCheckpoint()
    folds = sessions.fold_log(dense)
    assert len(folds) <= 4
    alone, columns = sessions.reconstruct_sessions(once), ["user_id", "start_event_id", "outcome", "elapsed_seconds"]
    closed = sessions.closed_in(folds).unionByName(sessions.run_out(sessions.timers_after(folds)))
    assert rows(sessions.sessions_of(closed), *columns) == rows(alone, *columns)


@pytest.mark.parametrize("sizes", [{}, {"chunk_starts": 5, "chunk_limit": 10}])
def test_pointers_and_fold_agree(spark, stand, sizes):
    """Two ways to the same sessions, on logs full of pauses, ties in time and ends at events."""
    dice = random.Random(11)
    data = []
    for user in range(6):
        now = 0
        for i in range(90):
            now += dice.choice([0, 0, 10, 30, 60])
            kind = dice.choice(["start", "toggle", "toggle", "toggle", "stop"] if user % 2 else ["start", "start", "toggle"])
            data.append((user, user * 1000 + i, T0 + dt.timedelta(seconds=now), kind, dice.choice([1, 2, 3]), i % 2 == 0, i))
    frame = spark.createDataFrame(data, TIMER).repartition(3)
    one, two = sessions.chained_sessions(frame, **sizes), sessions.reconstruct_sessions(frame, turns=99)
    assert rows(one) == rows(two.select(one.columns))


def test_jobs_grow_with_the_logarithm(spark):
    """A user's starts without stops, a minute each: it is not folded to its end."""
    from cairn.session import durable

    def run(n):
        seconds = F.col("id") * 7
        frame = durable(spark.range(n).select(
            F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"),
            (F.lit(T0) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"),
            F.lit("start").alias("kind"), F.lit(1).alias("planned_minutes"), F.lit(False).alias("is_break"),
            F.lit(None).cast("bigint").alias("task_id"),
        ))
        spark.sparkContext.setJobGroup(f"log-{n}", "")
        result = durable(sessions.reconstruct_sessions(frame, chunk_rows=64, turns=1))
        spark.sparkContext.setJobGroup("", "")
        assert [r[0] for r in result.select("start_event_id").orderBy("start_event_id").collect()] == list(range(0, n, 9))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"log-{n}"))

    small, large = run(4_000), run(64_000)
    # Sixteen times the log: four turns more, of two joins and two looks each.
    assert large - small <= 4 * 8
