"""Current task state from an event log ``(user_id, task_id, event_id, ts, kind)``.

Kinds are ``add``, ``activate``, ``complete``, ``reopen`` and ``toggle``. Events
before a task's first ``add`` touch nothing, and an id is added only once. Event
ids are unique: they settle the order of events at one moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.catalogue import ACTIVE, DONE, PENDING
from cairn.operators import ordered

TASK = ["user_id", "task_id"]


def fold_task_state(log: DataFrame) -> DataFrame:
    """Status and completion time of every task that was added.

    One aggregation with partial results before the shuffle, whatever the order
    of the rows: the last event decides the status, the last completion or
    reopening decides ``completed_at`` (activating a done task leaves it set).
    """
    at = F.struct("ts", "event_id")
    kind = F.col("kind")
    folded = log.filter(F.col("task_id").isNotNull()).groupBy(*TASK).agg(
        F.min(F.when(kind == "add", at)).alias("added"),
        F.max(F.when(kind.isin("activate", "complete", "reopen"), F.struct(*at_fields(), "kind"))).alias("last"),
        F.max(F.when(kind.isin("complete", "reopen"), F.struct(*at_fields(), "kind"))).alias("mark"),
    )
    existing = folded.filter(F.col("added").isNotNull())

    def after(column: str):
        return F.struct(f"{column}.ts", f"{column}.event_id") > F.col("added")

    status = (
        F.when(F.col("last").isNull() | ~after("last"), PENDING)
        .when(F.col("last.kind") == "activate", ACTIVE)
        .when(F.col("last.kind") == "complete", DONE)
        .otherwise(PENDING)
    )
    done_at = F.when(
        F.col("mark").isNotNull() & after("mark") & (F.col("mark.kind") == "complete"),
        F.col("mark.ts"),
    )
    return existing.select(
        *TASK,
        status.alias("status"),
        F.col("added.ts").alias("created_at"),
        done_at.alias("completed_at"),
    )


def at_fields() -> tuple[str, str]:
    """Order of events; the id settles ties in time."""
    return ("ts", "event_id")


def expand_toggles(log: DataFrame, **sizes: int) -> DataFrame:
    """Replace each ``toggle`` by the ``complete`` or ``reopen`` it stands for.

    A toggle reopens a done task and completes any other. Between two plain
    events toggles alternate, so it is enough to know the last plain event and
    how many toggles came since. Toggles of a task not yet added are dropped.
    """
    kind = F.col("kind")
    events = log.filter(F.col("task_id").isNotNull())
    counted = ordered.scan(
        events, TASK, list(at_fields()),
        _adds=ordered.total((kind == "add").cast("int")),
        _toggles=ordered.total((kind == "toggle").cast("int")),
        **sizes,
    )
    effective = (F.col("_adds") >= 1) & (
        kind.isin("activate", "complete", "reopen") | ((kind == "add") & (F.col("_adds") == 1))
    )
    # Only toggles after the first add count: the add remembers how many were before.
    setter = F.when(
        effective, F.struct((kind == "complete").alias("done"), F.col("_toggles").alias("seen"))
    )
    known = ordered.scan(
        counted, TASK, list(at_fields()), _set=ordered.latest(setter), **sizes
    )
    odd = (F.col("_toggles") - F.col("_set.seen")) % 2 == 1
    completes = F.col("_set.done") != odd
    meaning = F.when(completes, "complete").otherwise("reopen")
    kept = known.filter((kind != "toggle") | F.col("_set").isNotNull())
    return kept.withColumn("kind", F.when(kind == "toggle", meaning).otherwise(kind)).select(
        *log.columns
    )


def activations_from_focus(sessions: DataFrame) -> DataFrame:
    """``activate`` events of the tasks that accepted focus sessions were started on."""
    started = sessions.filter(~F.col("is_break") & F.col("task_id").isNotNull())
    return started.select(
        "user_id",
        "task_id",
        F.col("start_event_id").alias("event_id"),
        F.col("started_at").alias("ts"),
        F.lit("activate").alias("kind"),
    )
