"""Counters that follow the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions.columns import micros

LATE = "1 day"


def read_events(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """A file stream of parquet events under ``folder``, in batches of bounded size."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def on_event_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """Add ``event_time`` with a watermark.

    Watermarks need a point in time; zone-free times count as UTC, whatever the
    session zone.
    """
    point = F.timestamp_micros(micros(F.col("ts")))
    return events.withColumn("event_time", point).withWatermark("event_time", late)


COUNTERS = ["tasks_completed", "focus_minutes"]


def _counted(events: DataFrame, name: str, day: Column) -> DataFrame:
    kind = F.col("kind")
    return events.filter(kind.isin("complete", "focus")).select(
        "user_id",
        day.alias(name),
        (kind == "complete").cast("bigint").alias("tasks_completed"),
        F.when(kind == "focus", F.coalesce("duration_minutes", F.lit(0))).otherwise(0).cast("bigint")
        .alias("focus_minutes"),
    )


def stream_daily_activity(events: DataFrame) -> DataFrame:
    """What each event adds to the counters of its user and day; sum it up with ``sink.write_sums``.

    Late events count like all others, and no state is kept.
    """
    return _counted(events, "date", F.to_date("ts"))


def stream_weekly_activity(events: DataFrame) -> DataFrame:
    """What each event adds to the counters of its user and week from Monday."""
    return _counted(events, "week", F.to_date(F.date_trunc("week", F.col("ts"))))


def stream_windows(events: DataFrame, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Daily and weekly counters by event time, each as a stream to be written in update mode.

    A window is a state row until the watermark passes its end, so state is
    bounded by the users of the days (or weeks, from Monday) that are open;
    events later than that are left to :func:`stream_daily_activity`, whose sums
    need no state. A changed window is sent again as a whole: keep the newest.
    """
    counted = _counted(on_event_time(events, late).withColumn("ts", F.col("event_time")), "date", F.col("ts"))
    sums = [F.sum(c).alias(c) for c in COUNTERS]

    def by(width: str, name: str, start: str | None = None) -> DataFrame:
        window = F.window("date", width, startTime=start)
        rows = counted.groupBy("user_id", window.alias("w")).agg(*sums)
        # In the session's zone or not, the window begins at midnight UTC.
        begin = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("int(unix_seconds(w.start) div 86400)"))
        return rows.select("user_id", begin.alias(name), *COUNTERS)

    return by("1 day", "date"), by("7 days", "week", "4 days")


def stream_dedup(events: DataFrame, late: str = LATE, salts: int = 8) -> DataFrame:
    """Each ``event_id`` once, as long as copies arrive within the watermark.

    Copies are first thinned in ``salts`` groups, so an event that was sent very
    often is spread over that many tasks and the second step sees it at most
    ``salts`` times per batch. The salt may change when a batch is retried: the
    second step alone decides what passes. The price is that each id is kept and
    shuffled twice; use ``salts=1`` for sources that cannot repeat one id often.
    """
    timed = on_event_time(events, late)
    if salts > 1:
        salt = F.floor(F.rand() * salts)
        thinned = timed.withColumn("_salt", salt)
        timed = thinned.dropDuplicatesWithinWatermark(["event_id", "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(["event_id"])
