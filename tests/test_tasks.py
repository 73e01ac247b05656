"""Lists, trees, deletions and the event fold."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import state, tasks
from tests.helpers import DAILY, LOG, SESSIONS, TASKS, at, day, rows


def tree(spark, links, user=1):
    data = [
        (user, i, f"t{i}", parent, status, at("2024-01-01", f"{i % 24:02d}:00:00"), None)
        for i, parent, status in links
    ]
    return spark.createDataFrame(data, TASKS)


@pytest.fixture(scope="module")
def small(spark):
    return tree(
        spark,
        [(1, None, "done"), (2, 1, "pending"), (3, 2, "active"), (4, 1, "done"), (5, 99, "pending")],
    )


def test_lists(small):
    assert [r.id for r in tasks.list_tasks(small).collect()] == [1, 2, 3, 4, 5]
    assert [r.id for r in tasks.list_tasks(small, "pending").collect()] == [2, 5]
    assert [r.id for r in tasks.subtasks(small, 1).collect()] == [2, 4]
    assert tasks.task_by_id(small, 3).first().title == "t3"
    assert tasks.task_by_id(small, 30).isEmpty()
    wanted = small.select("user_id", (F.col("id") + 3).alias("id"))
    assert rows(tasks.find_tasks(small, wanted), "id", "title") == [
        (4, "t4"), (5, "t5"), (6, None), (7, None), (8, None)
    ]
    assert rows(tasks.open_count(small)) == [(1, 3)]


def test_board_order(small):
    assert [r.id for r in tasks.task_board(small, with_done=True).collect()] == [3, 2, 5, 1, 4]
    assert [r.id for r in tasks.task_board(small).collect()] == [3, 2, 5]


@pytest.mark.parametrize("sizes", [{}, {"limit": 1, "chunk_rows": 2}])
def test_open_list_places(stand, sizes):
    found = tasks.open_task_list(stand.tasks, **sizes)
    plain = tasks.open_task_list(stand.tasks)
    assert rows(found, "user_id", "status", "id", "position") == rows(
        plain, "user_id", "status", "id", "position"
    )


def test_groups_under_parent(small):
    found = tasks.tasks_by_parent(small)
    assert rows(found, "parent_id", "parent_status", "id") == [(1, "done", 2), (2, "pending", 3)]
    assert rows(tasks.dangling_parents(small), "id") == [(5,)]


def test_sessions_keep_their_rows(spark, small):
    sessions = spark.createDataFrame(
        [(1, 1, 3, 10, at("2024-01-01")), (1, 2, None, 10, at("2024-01-01")), (1, 3, 77, 10, at("2024-01-01"))],
        SESSIONS,
    )
    found = tasks.sessions_with_task(sessions, small)
    assert rows(found, "id", "task_title") == [(1, "t3"), (2, None), (3, None)]


def test_first_and_next(spark, small):
    row = tasks.first_open_task(small).first()
    assert (row.active_id, row.pending_id) == (3, 2)
    profiles = spark.createDataFrame(
        [(1, 10, True), (2, 20, False), (3, 12, True)],
        "user_id bigint, focus_minutes int, suggest_breakdown boolean",
    )
    others = tree(spark, [(7, None, "pending")], user=3).unionByName(small)
    assert rows(tasks.suggest_next(others, profiles)) == [
        (1, "continue", 3, "t3", 10, False),
        (2, "add_one", None, None, 20, False),
        (3, "start", 7, "t7", 12, True),
    ]


def test_descendants_of_a_long_chain(spark):
    links = [(i, i - 1 if i else None, "pending") for i in range(70)] + [(100, 101, "done"), (101, 100, "done")]
    chain = tree(spark, links)
    roots = chain.filter(F.col("id").isin(0, 40, 500))
    found = {r.id: (r.root_id, r.depth) for r in tasks.task_descendants(chain, roots).collect()}
    assert len(found) == 70 and found[39] == (0, 39) and found[40] == (40, 0) and found[69] == (40, 29)
    assert 100 not in found  # a loop hangs below no root


def test_delete_three_levels_up(spark):
    chain = tree(spark, [(1, None, "done"), (2, 1, "done"), (3, 2, "done"), (4, 3, "done"), (5, None, "done")])
    sessions = spark.createDataFrame(
        [(1, 1, 4, 10, at("2024-01-01")), (1, 2, 5, 10, at("2024-01-01")), (1, 3, None, 5, at("2024-01-01"))],
        SESSIONS,
    )
    kept, freed = tasks.delete_tasks(chain, sessions, chain.filter("id = 1"))
    assert rows(kept, "id") == [(5,)]
    assert rows(freed, "id", "task_id") == [(1, None), (2, 5), (3, None)]


def test_delete_all_tasks_keeps_minutes(spark, small):
    sessions = spark.createDataFrame([(1, 1, 3, 10, at("2024-01-01"))], SESSIONS)
    daily = spark.createDataFrame([(1, day("2024-01-01"), 4, 25), (2, day("2024-01-01"), 1, 5)], DAILY)
    users = spark.createDataFrame([(1,), (9,)], "user_id bigint")
    kept, left, reset, counts = tasks.delete_all_tasks(small, sessions, daily, users)
    assert kept.isEmpty() and left.isEmpty()
    assert rows(reset) == [(1, day("2024-01-01"), 0, 25), (2, day("2024-01-01"), 1, 5)]
    assert rows(counts) == [(1, 5), (9, 0)]


def test_delete_rows_flags(spark, small):
    doomed = spark.createDataFrame([(1, 2), (1, 50)], "user_id bigint, id bigint")
    kept, outcome = tasks.delete_rows(small, doomed, ["user_id", "id"])
    assert rows(kept, "id") == [(1,), (3,), (4,), (5,)]
    assert rows(outcome, "id", "deleted") == [(2, True), (50, False)]


def test_snapshot_diff(small):
    after = small.filter("id <> 4").withColumn("status", F.lit("done"))
    found = tasks.snapshot_diff(small.select("id", "status"), after.select("id", "status"))
    assert rows(found.groupBy("change").count()) == [("added", 3), ("removed", 4), ("same", 1)]


HISTORY = [
    (1, 10, 0, at("2024-01-01"), "complete"),  # unknown id: nothing to change
    (1, 10, 1, at("2024-01-02"), "add"),
    (1, 10, 2, at("2024-01-03"), "complete"),
    (1, 10, 3, at("2024-01-04"), "activate"),  # leaves the completion time
    (1, 11, 4, at("2024-01-02"), "add"),
    (1, 11, 5, at("2024-01-03"), "complete"),
    (1, 11, 6, at("2024-01-03"), "reopen"),  # same moment, higher id
    (1, 12, 7, at("2024-01-02"), "activate"),
    (1, 13, 8, at("2024-01-01"), "activate"),
    (1, 13, 9, at("2024-01-02"), "add"),
    (1, 14, 10, at("2024-01-02"), "add"),
    (1, 14, 11, at("2024-01-03"), "complete"),
    (1, 14, 12, at("2024-01-05"), "complete"),
    (1, 14, 13, at("2024-01-06"), "add"),  # ids are given once
]


def test_fold(spark):
    folded = [
        (10, "active", at("2024-01-03")), (11, "pending", None), (13, "pending", None),
        (14, "done", at("2024-01-05")),
    ]
    for seed in range(3):
        mixed = random.Random(seed).sample(HISTORY, len(HISTORY))
        found = state.fold_task_state(spark.createDataFrame(mixed, LOG).repartition(3))
        assert rows(found, "task_id", "status", "completed_at") == folded


@pytest.mark.parametrize("sizes", [{}, {"limit": 0, "chunk_rows": 2}])
def test_toggles(spark, sizes):
    kinds = ["toggle", "add", "toggle", "toggle", "toggle", "activate", "toggle", "complete", "toggle", "toggle", "add", "toggle"]
    log = spark.createDataFrame(
        [(1, 5, i, at("2024-01-01", f"00:00:{i:02d}"), k) for i, k in enumerate(kinds)], LOG
    )
    spelled = {r.event_id: r.kind for r in state.expand_toggles(log, **sizes).collect()}
    assert 0 not in spelled
    assert [spelled[i] for i in (2, 3, 4)] == ["complete", "reopen", "complete"]
    assert spelled[6] == "complete"
    assert [spelled[i] for i in (8, 9, 11)] == ["reopen", "complete", "reopen"]
    assert len(spelled) == len(kinds) - 1


@pytest.mark.parametrize("sizes", [{"limit": 3, "chunk_rows": 4}])
def test_large_tasks_toggle_alike(stand, sizes):
    kind = F.col("kind")
    log = stand.activity.filter(kind != "focus").withColumn(
        "kind", F.when(kind == "reopen", "toggle").otherwise(kind)
    )
    found = rows(state.expand_toggles(log, **sizes), "event_id", "kind")
    assert found == rows(state.expand_toggles(log), "event_id", "kind")
