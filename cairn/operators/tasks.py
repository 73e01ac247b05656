"""Task lists, sub-task trees and the next thing to do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.catalogue import ACTIVE, PENDING
from cairn.operators import ordered
from cairn.session import durable

BY_AGE = ("created_at", "id")


def task_by_id(tasks: DataFrame, task_id: int, user_id: int | None = None) -> DataFrame:
    """The task with this id, or no row."""
    found = tasks.filter(F.col("id") == task_id)
    return found if user_id is None else found.filter(F.col("user_id") == user_id)


def list_tasks(
    tasks: DataFrame, status: str | None = None, parent_id: int | None = None
) -> DataFrame:
    """Tasks, oldest first; a parent of ``None`` means any parent."""
    if status is not None:
        tasks = tasks.filter(F.col("status") == status)
    if parent_id is not None:
        tasks = tasks.filter(F.col("parent_id") == parent_id)
    return tasks.orderBy("user_id", *BY_AGE)


def find_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted ``(user_id, id)``, with nulls where there is no such task."""
    return wanted.select("user_id", "id").distinct().join(tasks, ["user_id", "id"], "left")


def subtasks(tasks: DataFrame, parent_id: int) -> DataFrame:
    """Children of one task, oldest first."""
    return list_tasks(tasks, parent_id=parent_id)


def subtasks_of(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of many tasks at once."""
    given = parents.select("user_id", F.col("id").alias("parent_id"))
    return tasks.filter(is_subtask()).join(given, ["user_id", "parent_id"], "left_semi")


def is_subtask() -> Column:
    """Whether a task has a parent."""
    return F.col("parent_id").isNotNull()


def open_count(tasks: DataFrame) -> DataFrame:
    """Active and pending tasks per user."""
    return tasks.groupBy("user_id").agg(
        F.count_if(F.col("status").isin(ACTIVE, PENDING)).alias("open_tasks")
    )


def _rank() -> Column:
    status = F.col("status")
    return F.when(status == ACTIVE, 0).when(status == PENDING, 1).otherwise(2)


def task_board(tasks: DataFrame, with_done: bool = False) -> DataFrame:
    """Active, then pending, then (if asked) done tasks, each oldest first."""
    kept = tasks if with_done else tasks.filter(F.col("status").isin(ACTIVE, PENDING))
    return kept.withColumn("board_rank", _rank()).orderBy("user_id", "board_rank", *BY_AGE)


def open_task_list(tasks: DataFrame, **sizes: int) -> DataFrame:
    """The two open lists of the status view: every open task with its place in its list."""
    kept = tasks.filter(F.col("status").isin(ACTIVE, PENDING))
    return ordered.scan(
        kept, ["user_id", "status"], list(BY_AGE), position=ordered.total(F.lit(1)), **sizes
    )


def tasks_by_parent(tasks: DataFrame, with_done: bool = False) -> DataFrame:
    """Visible sub-tasks beside their parent, whatever the parent's status."""
    kept = tasks if with_done else tasks.filter(F.col("status").isin(ACTIVE, PENDING))
    child = kept.filter(is_subtask()).alias("child")
    parent = tasks.alias("parent")
    same = (F.col("child.user_id") == F.col("parent.user_id")) & (
        F.col("child.parent_id") == F.col("parent.id")
    )
    return child.join(parent, same).select(
        "child.user_id",
        F.col("parent.id").alias("parent_id"),
        F.col("parent.title").alias("parent_title"),
        F.col("parent.status").alias("parent_status"),
        F.col("child.id").alias("id"),
        F.col("child.title").alias("title"),
        F.col("child.status").alias("status"),
        F.col("child.created_at").alias("created_at"),
    )


def sessions_with_task(sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Focus sessions beside their task, if they have one.

    Sessions without a task never enter the join: as one null key they would
    all land in a single task of the shuffle.
    """
    named = tasks.select(
        "user_id", F.col("id").alias("task_id"), F.col("title").alias("task_title"),
        F.col("status").alias("task_status"),
    )
    linked = sessions.filter(F.col("task_id").isNotNull()).join(
        named, ["user_id", "task_id"], "left"
    )
    free = sessions.filter(F.col("task_id").isNull())
    return linked.unionByName(free, allowMissingColumns=True)


def dangling_parents(tasks: DataFrame) -> DataFrame:
    """Sub-tasks whose parent does not exist."""
    parents = tasks.select("user_id", F.col("id").alias("parent_id"))
    return tasks.filter(is_subtask()).join(parents, ["user_id", "parent_id"], "left_anti")


def first_open_task(tasks: DataFrame) -> DataFrame:
    """Earliest active and earliest pending task per user."""
    row = F.struct("created_at", "id", "title")
    status = F.col("status")
    first = tasks.groupBy("user_id").agg(
        F.min(F.when(status == ACTIVE, row)).alias("a"),
        F.min(F.when(status == PENDING, row)).alias("p"),
    )
    return first.select(
        "user_id",
        F.col("a.id").alias("active_id"),
        F.col("a.title").alias("active_title"),
        F.col("p.id").alias("pending_id"),
        F.col("p.title").alias("pending_title"),
    )


def suggest_next(tasks: DataFrame, profiles: DataFrame) -> DataFrame:
    """What each user should start: an active task, else a pending one, else nothing.

    The break-down hint goes with a pending task when the profile asks for it.
    """
    open_rank = F.when(F.col("status").isin(ACTIVE, PENDING), _rank())
    row = F.when(open_rank.isNotNull(), F.struct(open_rank.alias("rank"), "created_at", "id", "title"))
    picked = tasks.groupBy("user_id").agg(F.min(row).alias("pick"))
    joined = picked.join(profiles, "user_id", "full")
    action = F.when(F.col("pick.rank") == 0, "continue").when(
        F.col("pick.rank") == 1, "start"
    ).otherwise("add_one")
    return joined.select(
        "user_id",
        action.alias("action"),
        F.col("pick.id").alias("task_id"),
        F.col("pick.title").alias("title"),
        F.coalesce("focus_minutes", F.lit(15)).alias("focus_minutes"),
        (
            (action == "start") & F.coalesce("suggest_breakdown", F.lit(False))
        ).alias("break_down_hint"),
    )


def task_descendants(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """All tasks at or below the given ones: ``(user_id, id, root_id, depth)``.

    ``root_id`` is the nearest given task above, so each task appears once and
    the result never outgrows the tasks. Pointers double each round: a chain of
    a million levels takes twenty joins, not a million. A round writes only the
    tasks that moved on; settled ones are written once and read again as
    targets. Tasks caught in a loop of parents that no root is part of are below
    no root and drop out: after as many rounds as the longest chain of the
    tasks in question could take, whoever still searches is in such a loop.
    """
    given = roots.select("user_id", F.col("id").alias("root_id")).distinct()
    tagged = tasks.select("user_id", "id", "parent_id").join(
        given.withColumn("id", F.col("root_id")), ["user_id", "id"], "left"
    )
    # jump = ancestor to look at next; found once root_id is set; lost once both are null.
    state = durable(
        tagged.select(
            "user_id",
            "id",
            "root_id",
            F.when(F.col("root_id").isNull(), F.col("parent_id")).alias("jump"),
            F.when(F.col("root_id").isNull(), 1).otherwise(0).cast("bigint").alias("depth"),
        ),
        "descendants",
    )
    searching = F.col("jump").isNotNull()
    done = state.filter(F.col("root_id").isNotNull())
    moving = state.filter(searching)
    left = moving.count()
    rounds = math.ceil(math.log2(left + 1)) + 1
    while left and rounds:
        target = done.unionByName(moving).select(
            "user_id",
            F.col("id").alias("jump"),
            F.col("root_id").alias("t_root"),
            F.col("jump").alias("t_jump"),
            F.col("depth").alias("t_depth"),
        )
        # Lost rows are dropped by the inner join: whoever points at one is lost as well.
        moved = durable(
            moving.join(target, ["user_id", "jump"]).select(
                "user_id",
                "id",
                F.col("t_root").alias("root_id"),
                F.col("t_jump").alias("jump"),
                (F.col("depth") + F.col("t_depth")).alias("depth"),
            ),
            "descendants",
        )
        done = done.unionByName(moved.filter(F.col("root_id").isNotNull()))
        moving = moved.filter(searching)
        left = moving.count()
        rounds -= 1
    return done.select("user_id", "id", "root_id", "depth")


def delete_tasks(tasks: DataFrame, sessions: DataFrame, doomed: DataFrame):
    """Remove tasks with everything below them; their sessions stay without a task.

    Returns ``(tasks, sessions)``. Daily counters do not change.
    """
    gone = durable(task_descendants(tasks, doomed).select("user_id", "id"), "gone")
    kept = tasks.join(gone, ["user_id", "id"], "left_anti")
    linked = sessions.filter(F.col("task_id").isNotNull())
    free = sessions.filter(F.col("task_id").isNull())
    cut = gone.select("user_id", F.col("id").alias("task_id"), F.lit(True).alias("_gone"))
    freed = linked.join(cut, ["user_id", "task_id"], "left").withColumn(
        "task_id", F.when(F.col("_gone").isNull(), F.col("task_id"))
    ).drop("_gone")
    return kept, freed.unionByName(free)


def _given(users: DataFrame) -> DataFrame:
    """Distinct users as a written table.

    Its size is known, and in a join straight from scans the shuffle can still
    split a user that holds most of the other side.
    """
    return durable(users.select("user_id").distinct(), "users")


def delete_all_tasks(tasks: DataFrame, sessions: DataFrame, daily: DataFrame, users: DataFrame):
    """Remove all tasks and sessions of the given users and zero their task counters.

    Focus minutes stay. Returns ``(tasks, sessions, daily, counts)`` with the
    number of tasks removed per user.
    """
    given = _given(users)
    marked = daily.join(given.withColumn("_given", F.lit(True)), "user_id", "left")
    reset = marked.withColumn(
        "tasks_completed",
        F.when(F.col("_given"), F.lit(0).cast("bigint")).otherwise(F.col("tasks_completed")),
    ).drop("_given")
    removed = tasks.join(given, "user_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("deleted")
    )
    counts = given.join(removed, "user_id", "left").select(
        "user_id", F.coalesce("deleted", F.lit(0)).alias("deleted")
    )
    return (
        tasks.join(given, "user_id", "left_anti"),
        sessions.join(given, "user_id", "left_anti"),
        reset,
        counts,
    )


def delete_rows(rows: DataFrame, doomed: DataFrame, keys: list[str]):
    """Remove rows by key, as ``(kept, outcome)``; ``outcome`` flags each asked key.

    For results and sessions by ``user_id, id`` and for daily rows by
    ``user_id, date``; the counters are not adjusted.
    """
    marked = _marked(rows, doomed.select(*keys).distinct(), keys)
    kept = marked.filter("_stored and not _asked").select(*rows.columns)
    outcome = marked.filter("_asked").groupBy(*keys).agg(F.bool_or("_stored").alias("deleted"))
    return kept, outcome


def _marked(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and asked keys in one full join, as ``_stored`` and ``_asked``, written once.

    What is kept and what was found both read that table, so neither the rows
    nor the keys are derived again however they came about.
    """
    stored = rows.withColumn("_stored", F.lit(True))
    joined = stored.join(asked.withColumn("_asked", F.lit(True)), keys, "full")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("_stored", "_asked")}
    return durable(joined.withColumns(flags), "marked")


def delete_all_results(results: DataFrame, users: DataFrame):
    """Remove all results of the given users, as ``(kept, counts)``."""
    given = _given(users)
    # Written once; a left join, which can still be split at a user with very many results.
    marked = durable(results.join(given.withColumn("_asked", F.lit(True)), "user_id", "left"), "marked")
    removed = marked.filter("_asked").groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted"))
    counts = given.join(removed, "user_id", "left").select(
        "user_id", F.coalesce("deleted", F.lit(0)).alias("deleted")
    )
    return marked.filter("_asked is null").select(*results.columns), counts


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that were removed, added or stayed the same, each with its number ``n``.

    Snapshots are bags: a row that is twice in one and once in the other is the
    same once, and removed or added once. One aggregation over both of them.
    """
    sides = before.withColumn("_side", F.lit(0)).unionByName(after.withColumn("_side", F.lit(1)))
    counted = sides.groupBy(*before.columns).agg(
        F.count_if(F.col("_side") == 0).alias("_old"), F.count_if(F.col("_side") == 1).alias("_new")
    )
    old, new = F.col("_old"), F.col("_new")
    changes = F.array(*[
        F.struct(F.lit(name).alias("change"), n.alias("n"))
        for name, n in (("removed", old - new), ("added", new - old), ("same", F.least(old, new)))
    ])
    each = F.explode(F.filter(changes, lambda c: c["n"] > 0)).alias("_c")
    return counted.select(*before.columns, each).select(*before.columns, "_c.*")

