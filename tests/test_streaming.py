"""Streams end where the batch operators end."""

import contextlib
import datetime as dt
import pathlib
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import profiles, sessions
from cairn.plans.queries import QUERIES
from cairn.session import new_folder, run_folder, shared_folder
from cairn.streaming import activity, chains, sink, timers
from tests.conftest import DATA


def same(left, right):
    columns = sorted(left.columns)
    left, right = left.select(columns), right.select(columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize(
    "stream,batch", [("stream_daily_activity", "daily_activity"), ("stream_latest_profile", "profile_blended")]
)
def test_stream_equals_batch(spark, stream, batch):
    assert same(QUERIES[stream](spark, DATA), QUERIES[batch](spark, DATA))


def test_weeks_are_sums_of_days(spark, stand):
    weekly = QUERIES["stream_weekly_activity"](spark, DATA)
    days = stand.daily.groupBy(
        "user_id", F.to_date(F.date_trunc("week", F.col("date"))).alias("week")
    ).agg(F.sum("tasks_completed").alias("tasks_completed"), F.sum("focus_minutes").alias("focus_minutes"))
    assert same(weekly, days)


DAILY_SCHEMA = "user_id bigint, date date, tasks_completed bigint, focus_minutes bigint"


def test_counters_over_several_batches_late_rows_and_compaction(spark, stand):
    """Files arrive one by one, the oldest days last; batches put together say the same."""
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.activity.filter("kind <> 'focus' or duration_minutes between 1 and 120")
    for part in range(4, 0, -1):
        own = events.filter(F.pmod(F.dayofmonth("ts"), F.lit(4)) == part - 1)
        own.coalesce(1).write.mode("append").parquet(source)
    stream = activity.read_events(spark, source, events.schema, files_per_batch=1)
    keys = ["user_id", "date"]
    path = sink.run_sums(activity.stream_daily_activity(stream), "daily", keys, activity.COUNTERS)
    numbers = spark.read.option("basePath", path).parquet(path).select("batch_id").distinct().count()
    assert numbers >= 4
    assert same(sink.read_sums(spark, path, DAILY_SCHEMA, keys), stand.daily)
    sink.compact(spark, path, DAILY_SCHEMA, keys, upto=3, sums=True)
    assert spark.read.option("basePath", path).parquet(path).select("batch_id").distinct().count() == numbers - 3
    assert same(sink.read_sums(spark, path, DAILY_SCHEMA, keys), stand.daily)


@pytest.mark.parametrize("step", ["_merge", "_swap", "_clear", "remove"])
def test_compaction_may_break_off_anywhere(spark, monkeypatch, step):
    """Before and after every step readers see the same sums; the next run ends the work."""
    path, schema = new_folder(spark, "sums"), "k bigint, n bigint"
    for batch in range(4):
        spark.range(3).selectExpr("id as k", f"id + {batch} as n").write.parquet(f"{path}/batch_id={batch}")
    want = {(k, 4 * k + 6) for k in range(3)}
    read = lambda: {tuple(r) for r in sink.read_sums(spark, path, schema, ["k"]).collect()}
    for upto in (2, 3):
        for after in (False, True):
            real = getattr(sink, step)

            def broken(*args):
                if after:
                    real(*args)
                raise RuntimeError("killed")

            monkeypatch.setattr(sink, step, broken)
            with contextlib.suppress(RuntimeError):
                sink.compact(spark, path, schema, ["k"], upto, sums=True)
            monkeypatch.setattr(sink, step, real)
            assert read() == want
        sink.compact(spark, path, schema, ["k"], upto, sums=True)
        assert read() == want
    left = sorted(p.name for p in pathlib.Path(path.removeprefix("file:")).iterdir() if p.name.startswith("batch"))
    assert left == ["batch_id=3"] and len(list(pathlib.Path(f"{path}/_merged").iterdir())) == 1


@pytest.mark.parametrize("salts", [1, 8])
def test_copies_pass_once(spark, stand, salts):
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.table("events")
    hot = events.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy")
    events.unionByName(hot).repartition(3).write.mode("append").parquet(source)
    stream = activity.read_events(spark, source, events.schema, files_per_batch=1)
    once = activity.stream_dedup(stream, late="40 days", salts=salts).select("event_id")
    path = sink.run_available(once, "dedup", "append")
    assert same(sink.read_appended(spark, path, "event_id bigint"), events.select("event_id"))


def run_sessions(spark, source, schema, late):
    stream = activity.read_events(spark, source, schema, files_per_batch=1)
    path = new_folder(spark, "sessions")
    timers.stream_sessions(stream, path, new_folder(spark, "progress"), late).awaitTermination()
    return path


def test_sessions_by_stream_and_by_batch(spark, stand):
    """Three micro-batches in order, none late: ended, waiting and open sessions together are all of them."""
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.timer_events
    events.repartitionByRange(3, "ts").write.mode("append").parquet(source)
    path = run_sessions(spark, source, events.schema, dt.timedelta(days=40))
    assert timers.read_late(spark, path).isEmpty()
    assert same(timers.whole_sessions(spark, path), sessions.reconstruct_sessions(events))
    path = run_sessions(spark, source, events.schema, dt.timedelta(hours=1))
    ended = timers.read_sessions(spark, path)
    late = timers.read_late(spark, path).select("event_id")
    assert not ended.isEmpty()
    on_time = sessions.reconstruct_sessions(events.join(late, "event_id", "left_anti"))
    assert same(timers.whole_sessions(spark, path), on_time)


def test_late_timer_events_are_kept_aside(spark, stand):
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.timer_events
    for day in (20, 2):  # the older day comes second
        own = events.filter(F.dayofmonth("ts") == day)
        own.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    path = run_sessions(spark, source, events.schema, dt.timedelta(hours=1))
    old = events.filter(F.dayofmonth("ts") == 2)
    assert same(timers.read_late(spark, path).select("event_id"), old.select("event_id"))


def test_late_timer_events_are_put_in(spark, stand, monkeypatch):
    """Days in any order, a correction that breaks off, one between two runs: always the sessions of the batch."""
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.timer_events
    path, progress = new_folder(spark, "sessions"), new_folder(spark, "progress")
    seen = events.limit(0)

    def day(number):
        own = events.filter(F.dayofmonth("ts") == number)
        own.coalesce(1).write.mode("append").parquet(source)
        stream = activity.read_events(spark, source, events.schema, files_per_batch=1)
        timers.stream_sessions(stream, path, progress, dt.timedelta(hours=1)).awaitTermination()
        return seen.unionByName(own)

    for number in (12, 3):
        seen = day(number)
    assert not timers.read_late(spark, path).isEmpty()
    before = timers.read_sessions(spark, path).collect()
    real = timers.sessions.sessions_of
    monkeypatch.setattr(timers.sessions, "sessions_of", lambda closed: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        timers.settle_late(seen, path)
    monkeypatch.setattr(timers.sessions, "sessions_of", real)
    assert sorted(map(str, timers.read_sessions(spark, path).collect())) == sorted(map(str, before))
    timers.settle_late(seen, path)
    assert timers.read_late(spark, path).isEmpty()
    assert same(timers.whole_sessions(spark, path), sessions.reconstruct_sessions(seen))
    timers.settle_late(seen, path)  # nothing left to do
    for number in (20, 11):
        seen = day(number)
    assert not timers.read_late(spark, path).isEmpty()
    timers.settle_late(seen, path)
    assert same(timers.whole_sessions(spark, path), sessions.reconstruct_sessions(seen))


def test_chains_by_stream_and_by_batch(spark):
    """Five micro-batches cut through chains: focus and break by turns, one user in a row, one with idle spells."""
    source = tempfile.mkdtemp(prefix="cairn-test-")
    log = [(1, n, 60 * n, n % 2 == 1) for n in range(200)]
    log += [(2, 1000 + n, 60 * n + 3600 * (n // 7), n % 2 == 1) for n in range(30)]
    log += [(3, 2000 + n, 60 * n, n % 5 == 1) for n in range(100)]
    log += [(4, 3000, 0, False)]
    events = spark.createDataFrame(
        [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), "start", 1, b, u) for u, i, s, b in log],
        "user_id bigint, event_id bigint, ts timestamp_ntz, kind string, planned_minutes int, is_break boolean, task_id bigint",
    )
    midnight, hour = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"), F.expr("interval 1 hour")
    for part in range(5):
        own = events.filter((F.col("ts") >= midnight + part * hour) & ((F.col("ts") < midnight + (part + 1) * hour)))
        own.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    path = new_folder(spark, "chains")
    stream = activity.read_events(spark, source, events.schema, files_per_batch=1)
    chains.stream_chains(stream, path, new_folder(spark, "progress"), 1.0, dt.timedelta(minutes=5)).awaitTermination()
    read = events.filter(F.col("ts") < midnight + 5 * hour)
    want = sessions.joined_chains(sessions.chain_pieces(sessions.reconstruct_sessions(read)), 1.0)
    want = want.select("user_id", "start_event_id", *sessions.CHAIN_COLUMNS, F.col("task.task_id").alias("task_id"))
    found = chains.whole_chains(spark, path, 1.0)
    assert same(found, want)
    assert found.filter("user_id = 1").select("sessions").collect() == [(200,)]
    held = timers.every_part(spark, path, "chains-open").groupBy("batch").agg(F.collect_set("user_id").alias("users"))
    held = {r["batch"]: set(r["users"]) for r in held.collect()}
    assert len(held) > 2 and all(4 not in users for users in held.values())  # idle users are not kept
    assert all(1 in held[n] for n in range(3))
    last = timers.last_batch(spark, path)
    before = chains.read_chains(spark, path).collect()
    chains.fold_chains(spark, path, last, 1.0)  # tried again
    assert sorted(map(str, chains.read_chains(spark, path).collect())) == sorted(map(str, before))
    assert same(chains.whole_chains(spark, path, 1.0), want)


def test_chains_of_corrected_sessions_are_refused(spark, stand):
    """Late events change sessions: chains as first folded no longer hold."""
    source = tempfile.mkdtemp(prefix="cairn-test-")
    events = stand.timer_events
    path, progress = new_folder(spark, "chains"), new_folder(spark, "progress")
    for day in (12, 3):
        events.filter(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(source)
        stream = activity.read_events(spark, source, events.schema, files_per_batch=1)
        chains.stream_chains(stream, path, progress).awaitTermination()
    chains.read_chains(spark, path)
    timers.settle_late(spark.read.parquet(source), path)
    with pytest.raises(ValueError):
        chains.read_chains(spark, path)


def test_nothing_is_left_behind_a_run(spark, stand):
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    with run_folder(spark) as path:
        assert sessions.reconstruct_sessions(stand.timer_events).count() > 0
        assert any(pathlib.Path(path.removeprefix("file:")).iterdir())
    assert set(shared.iterdir()) == before


def test_state_is_one_row_per_user(spark, stand):
    folder = new_folder(spark, "results")
    stand.results.repartition(4).write.parquet(folder)
    stream = activity.read_events(spark, folder, stand.results.schema, files_per_batch=1)
    from cairn.streaming import profiles as stream_profiles

    path = sink.run_available(stream_profiles.stream_latest_profile(stream), "profiles")
    schema = (
        "user_id bigint, focus_minutes int, break_minutes int, nudge_style string, "
        "suggest_breakdown boolean, encourage_reward boolean, add_reassurance boolean"
    )
    current = sink.read_current(spark, path, schema, ["user_id"])
    assert same(current, profiles.profile_blended(stand.latest))


def test_windows_forget_and_sums_do_not(spark, stand):
    """Days in order are all counted; a day that comes after the watermark is left to the sums."""
    source, keys = tempfile.mkdtemp(prefix="cairn-test-"), ["user_id", "date"]
    events = stand.activity.filter("kind <> 'focus' or duration_minutes between 1 and 120")
    for days in ((1, 10), (11, 20), (21, 31), (0, 0)):
        own = events.filter(F.dayofmonth("ts").between(*days)) if days[0] else events.filter(F.dayofmonth("ts") == 2)
        own.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    stream = lambda: activity.read_events(spark, source, events.schema, files_per_batch=1)
    daily, _ = activity.stream_windows(stream())
    windows = sink.read_current(spark, sink.run_available(daily, "windows"), DAILY_SCHEMA, keys)
    assert same(windows, stand.daily)  # day 2 came a second time, too late
    sums = sink.read_sums(
        spark, sink.run_sums(activity.stream_daily_activity(stream()), "sums", keys, activity.COUNTERS), DAILY_SCHEMA, keys)
    again = stand.daily.filter(F.dayofmonth("date") == 2)
    assert same(sums, stand.daily.unionByName(again).groupBy(*keys).agg(
        F.sum("tasks_completed").alias("tasks_completed"), F.sum("focus_minutes").alias("focus_minutes")))
