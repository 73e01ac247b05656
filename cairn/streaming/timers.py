"""Timer sessions as they happen, by the fold that the batch operator uses.

Each micro-batch is folded in the JVM from the timers that the batches before
left set. What it leaves behind lies beside the sessions in one folder per
batch, so a batch that is tried again replaces its own output only:

- ``sessions``: sessions that ended, once each;
- ``timers``: timers still set;
- ``waiting``: events newer than the watermark, which may still be overtaken;
- ``late``: events older than what had been folded when they came, kept until
  :func:`settle_late` has put them in;
- ``marks``: how far the log is folded.

What ``settle_late`` finds lies in folders of the same kind, ``fixed-*``, under
the number of the last batch it follows; ``fixed-marks`` comes last and makes
readers and the next batch follow it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.columns import from_micros, micros
from cairn.operators import sessions
from cairn.session import durable

COLUMNS = ("user_id", "event_id", "ts", "kind", "planned_minutes", "is_break", "task_id")


def read_part(reader: DataFrameReader, path: str) -> DataFrame | None:
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fold_batch(batch: DataFrame, path: str, number: int, late: dt.timedelta) -> None:
    """Fold one micro-batch into the folder of its number, from that of the one before."""
    spark = batch.sparkSession
    rows = durable(batch.select(*COLUMNS), "stream-batch")
    mark = read_part(spark.read, f"{path}/marks/batch={number - 1}")
    before = mark.first()["safe"] if mark is not None else None
    newest = rows.agg(F.max("ts")).first()[0]
    known = [t for t in (before, newest - late if newest else None) if t is not None]
    safe = max(known) if known else None
    point = lambda t: F.lit(t).cast("timestamp_ntz")
    overtaken = F.col("ts") < point(before) if before else F.lit(False)
    held = read_part(spark.read, f"{path}/waiting/batch={number - 1}")
    waiting = rows.filter(~overtaken)
    waiting = waiting.unionByName(held.select(*COLUMNS)) if held is not None else waiting
    timers = _timers(spark, path, number - 1)
    passed = F.col("ts") < point(safe) if safe else F.lit(False)
    folds = sessions.fold_log(waiting.filter(passed), timers)
    left = durable(sessions.timers_after(folds), "timers")
    over = F.coalesce(sessions.timer_end() < micros(point(safe)), F.lit(False)) if safe else F.lit(False)
    ended = sessions.closed_in(folds).unionByName(sessions.run_out(left.filter(over)))

    def put(frame: DataFrame, name: str) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    put(sessions.sessions_of(ended), "sessions")
    put(left.filter(~over), "timers")
    put(waiting.filter(~passed), "waiting")
    put(rows.filter(overtaken), "late")
    put(spark.range(1).select(point(safe).alias("safe")), "marks")  # last: the batch is whole


def stream_sessions(
    events: DataFrame, path: str, checkpoint: str, late: dt.timedelta = dt.timedelta(hours=1),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that keeps sessions under ``path``; by default it ends when all input is read."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, number: fold_batch(batch, path, number, late))
        .start()
    )


def every_part(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All batches of a table, with the column ``batch``."""
    return read_part(spark.read.option("basePath", f"{path}/{name}"), f"{path}/{name}")


def _fixed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of corrections that came to their end, with the column ``batch``."""
    whole = every_part(spark, path, "fixed-marks")
    return None if whole is None else every_part(spark, path, f"fixed-{name}").join(whole.select("batch"), "batch", "left_semi")


def _timers(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """(user_id, timer) set after a batch and the correction that followed it, if any."""
    timers = read_part(spark.read, f"{path}/timers/batch={number}")
    fixed = _fixed(spark, path, "timers")
    if timers is None or fixed is None:
        return timers
    again = _fixed(spark, path, "begins").filter(F.col("batch") == number)
    held = fixed.filter(F.col("batch") == number).drop("batch")
    return timers.join(again, "user_id", "left_anti").unionByName(held.select(*timers.columns))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions that have ended by the watermark; of corrected ones the last form."""
    found = every_part(spark, path, "sessions")
    fixed = _fixed(spark, path, "sessions")
    if fixed is None:
        return found.drop("batch")
    columns = [name for name in found.columns if name != "batch"]
    # A correction follows the batch of its number and comes before the next.
    turn = lambda late: (F.col("batch").cast("bigint") * 2 + late).alias("_turn")
    every = found.select(*columns, turn(0)).unionByName(fixed.select(*columns, turn(1)))
    begins = _fixed(spark, path, "begins").select("user_id", "begin", turn(1))
    replaced = (
        (F.col("s.user_id") == F.col("b.user_id"))
        & (F.col("b._turn") > F.col("s._turn"))
        & (F.col("b.begin") <= F.struct(F.col("s.started_at").alias("ts"), F.col("s.start_event_id").alias("event_id")))
    )
    return every.alias("s").join(begins.alias("b"), replaced, "left_anti").select(*columns)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The events that came too late to be folded and have not been put in since."""
    late, settled = every_part(spark, path, "late"), every_part(spark, path, "fixed-marks")
    if settled is not None:
        late = late.filter(F.col("batch") > settled.agg(F.max("batch")).first()[0])
    return late.drop("batch")


def last_batch(spark: SparkSession, path: str) -> int:
    return every_part(spark, path, "marks").agg(F.max("batch")).first()[0]


def settle_late(log: DataFrame, path: str) -> None:
    """Put late events in: what follows the last idle moment before a user's first one is folded again.

    ``log`` is the stored log that the stream reads, late events included. Just
    before a session starts its user is idle, whatever came earlier; so the
    last session that began before the first late event gives the place, or else
    that event itself. From there on the user's log is folded to where
    the stream has come, and the sessions and the timer found replace the
    user's former ones. Other users are not read further than a join.

    Run it between two runs of the stream. It may break off anywhere and be run
    again; without late events it does nothing.
    """
    spark = log.sparkSession
    late = durable(read_late(spark, path), "late")
    if late.isEmpty():
        return
    number = last_batch(spark, path)
    safe = read_part(spark.read, f"{path}/marks/batch={number}").first()["safe"]
    place = F.struct("ts", "event_id")
    firsts = late.groupBy("user_id").agg(F.min(place).alias("first"))
    ended = read_sessions(spark, path).select(
        "user_id", F.struct(F.col("started_at").alias("ts"), F.col("start_event_id").alias("event_id")).alias("start"))
    running = _timers(spark, path, number).select("user_id", F.struct(
        from_micros(F.col("timer.started")).alias("ts"), F.col("timer.start_event_id").alias("event_id")).alias("start"))
    starts = ended.unionByName(running).join(firsts, "user_id").filter(F.col("start") < F.col("first"))
    idle = starts.groupBy("user_id").agg(F.max("start").alias("start"))
    begins = durable(
        firsts.join(idle, "user_id", "left").select("user_id", F.coalesce("start", "first").alias("begin")), "begins")
    point = F.lit(safe).cast("timestamp_ntz")
    tail = log.filter(F.col("ts") < point).join(begins, "user_id").filter(place >= F.col("begin"))
    folds = sessions.fold_log(tail.select(*COLUMNS))
    left = durable(sessions.timers_after(folds), "timers")
    over = F.coalesce(sessions.timer_end() < micros(point), F.lit(False))
    closed = sessions.closed_in(folds).unionByName(sessions.run_out(left.filter(over)))

    def put(frame: DataFrame, name: str) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/fixed-{name}/batch={number}")

    put(begins, "begins")
    put(sessions.sessions_of(closed), "sessions")
    put(left.filter(~over), "timers")
    put(spark.range(1), "marks")  # last: the correction is whole


def tail_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions still to come once a stream is over: waiting events and timers, folded to their end."""
    last = last_batch(spark, path)
    waiting = read_part(spark.read, f"{path}/waiting/batch={last}")
    folds = sessions.fold_log(waiting, _timers(spark, path, last))
    return sessions.sessions_of(sessions.closed_in(folds).unionByName(sessions.run_out(sessions.timers_after(folds))))


def whole_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions once a stream is over: what has ended, and what was still to come."""
    done = read_sessions(spark, path)
    return done.unionByName(tail_sessions(spark, path).select(*done.columns))
