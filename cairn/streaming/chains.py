"""Chains of alternating sessions as they happen.

Sessions come from the fold of :mod:`cairn.streaming.timers`; each micro-batch
joins those that it ended to the chain that the user's last one may still go on
with. Beside the tables of that module lie, one folder per batch:

- ``chains``: chains that are over, once each;
- ``chains-open``: at most one chain per user that the next session may join.

A chain is over when its last session was not completed, when a later session
does not join it, or when no session can start within the gap any more: the log
is folded to the watermark, so the next one starts with the timer that is set or
after the watermark. What is kept grows with the users who are at it, not with
all users.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.columns import MICROS_PER_SECOND, micros
from cairn.operators import sessions
from cairn.session import durable
from cairn.streaming import timers


def fold_chains(spark: SparkSession, path: str, number: int, gap_seconds: float = 1.0) -> None:
    """Join the sessions of one batch, which ``timers.fold_batch`` has written, to the chains still open."""
    pieces = sessions.chain_pieces(spark.read.parquet(f"{path}/sessions/batch={number}"))
    held = timers.read_part(spark.read, f"{path}/chains-open/batch={number - 1}")
    if held is not None:
        pieces = pieces.unionByName(held.select(*pieces.columns))
    found = durable(sessions.joined_chains(durable(pieces, "chain-pieces"), gap_seconds), "chains")
    safe = spark.read.parquet(f"{path}/marks/batch={number}").first()["safe"]
    point = micros(F.lit(safe).cast("timestamp_ntz"))
    running = spark.read.parquet(f"{path}/timers/batch={number}").select("user_id", F.col("timer.started").alias("_set"))
    last = found.groupBy("user_id").agg(F.max("chain").alias("_last"))
    placed = found.join(last, "user_id").join(running, "user_id", "left")
    in_time = F.coalesce("_set", point) - micros(F.col("ended_at")) <= int(gap_seconds * MICROS_PER_SECOND)
    is_open = (F.col("chain") == F.col("_last")) & F.col("last_completed") & F.coalesce(in_time, F.lit(True))

    def put(frame: DataFrame, name: str) -> None:
        frame.drop("_last", "_set", "chain").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    put(placed.filter(~is_open), "chains")
    put(placed.filter(is_open), "chains-open")


def stream_chains(
    events: DataFrame, path: str, checkpoint: str, gap_seconds: float = 1.0, late: dt.timedelta = dt.timedelta(hours=1),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that keeps sessions and their chains under ``path``; by default it ends when all input is read.

    A batch that is tried again replaces its own sessions and chains only.
    """

    def fold(batch: DataFrame, number: int) -> None:
        timers.fold_batch(batch, path, number, late)
        fold_chains(batch.sparkSession, path, number, gap_seconds)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(fold)
        .start()
    )


def _uncorrected(spark: SparkSession, path: str) -> None:
    if timers.every_part(spark, path, "fixed-marks") is not None:
        raise ValueError("late events changed these sessions: take auto_cycle_chains of read_sessions")


def _shown(chains: DataFrame) -> DataFrame:
    return chains.select("user_id", "start_event_id", *sessions.CHAIN_COLUMNS, F.col("task.task_id").alias("task_id"))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """The chains that are over by the watermark, named by the event that began them.

    Chains follow the sessions as first folded. Once ``timers.settle_late`` has
    changed some, they no longer hold, and this raises a ValueError.
    """
    _uncorrected(spark, path)
    return _shown(timers.every_part(spark, path, "chains"))


def whole_chains(spark: SparkSession, path: str, gap_seconds: float = 1.0) -> DataFrame:
    """All chains once a stream is over: those that ended, and open ones joined with the sessions still to come."""
    held = spark.read.parquet(f"{path}/chains-open/batch={timers.last_batch(spark, path)}")
    pieces = sessions.chain_pieces(timers.tail_sessions(spark, path))
    rest = sessions.joined_chains(durable(pieces.unionByName(held.select(*pieces.columns)), "chain-pieces"), gap_seconds)
    return read_chains(spark, path).unionByName(_shown(rest))
