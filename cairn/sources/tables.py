"""Reading and appending the record tables with their explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import ordered
from cairn.session import durable

# The column whose day each fact table is partitioned by.
DAY_OF = {
    "tasks": "created_at",
    "focus_sessions": "completed_at",
    "assessments": "taken_at",
    "act_journal_entries": "created_at",
}
DAY, BATCH = "day", "batch"
# Partitions of tables with few rows a day are months, named by their first day.
MONTHLY = {"tasks", "assessments", "act_journal_entries"}


RAW_LINE = schemas.RAW_LINE


def read_table(
    spark: SparkSession, path: str, table: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """One record table. CSV and JSON keep every column as text: decode them next.

    A line that cannot be read at all is a row too, whole in ``raw_line``. CSV
    files are split between tasks unless ``multi_line`` asks for texts with line
    breaks, which makes each file one task. A table partitioned by day has the
    partition column ``day`` too, so that filters on it skip whole days.
    """
    schema = schemas.TABLES[table]
    reader = spark.read
    if fmt in ("csv", "json"):
        schema = schemas.text_form(schema)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
    reader = reader.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.load(path)


def scan_tables(
    spark: SparkSession, folder: str, fmt: str = "parquet", names: list[str] | None = None
) -> dict[str, DataFrame]:
    """All record tables under one folder, by name."""
    return {
        name: read_table(spark, f"{folder}/{name}", name, fmt)
        for name in (names or schemas.TABLES)
    }


def on_days(table: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Rows from ``first`` to ``last``; the partition column lets whole days or months be skipped."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    exact = F.to_date(time).between(low, high)
    return table.filter(F.col(DAY).between(F.trunc(low, "month"), high) & exact) if DAY in table.columns else table.filter(exact)


def on_asked_days(table: DataFrame, time: str, days: DataFrame) -> DataFrame:
    """Rows whose ``time`` falls on one of the asked days, a DataFrame with a column ``date``.

    Only the partitions of these days, or of their months, are read: the
    planner prunes them by what the days turn out to be. A list of up to
    ``MOST_DAYS`` days is sent to the readers; a longer one is joined. Null
    times and null days match nothing.
    """
    asked = durable(days.filter(F.col("date").isNotNull()).select(F.col("date").alias("_asked")).distinct(), "asked-days")
    few = asked.count() <= MOST_DAYS
    if DAY in table.columns:
        # Partitions are named by their day or by the first of their month. The bound says that days select.
        part = F.explode(F.array_distinct(F.array("_asked", F.trunc("_asked", "month").cast("date"))))
        parts = asked.select(part.alias("_part")).distinct().filter(F.col("_part") > F.lit("0001-01-01").cast("date"))
        table = table.join(F.broadcast(parts) if few else parts, F.col(DAY) == F.col("_part"), "left_semi")
    return table.join(F.broadcast(asked) if few else asked, F.to_date(time) == F.col("_asked"), "left_semi")


def append(
    batch: DataFrame, path: str, table: str, batch_id: int, order: list[str] | None = None
) -> DataFrame:
    """Append new records to a parquet table partitioned by batch and day; returns what was added.

    Records without ids are numbered after the highest id of earlier batches.
    That number comes from ``<path>_marks``, where each batch leaves one row, so
    stored records are never read. Appending a batch again under its
    ``batch_id`` draws the same ids and replaces its own partitions only: a
    retry adds nothing. One writer at a time, with batch ids that grow. Rows are
    gathered by day; rebalancing splits a day with very many rows over several
    writers and puts small days together.
    """
    spark = batch.sparkSession
    schema = schemas.TABLES[table]
    # The folder of a batch's mark is written before its rows, with the ids it may use.
    first = _first_id(spark, path, batch_id)
    if "id" not in batch.columns and "id" in schema.names:
        batch = ordered.number(batch, order or [DAY_OF[table], "user_id"], "id", first)
    batch = durable(batch.select(*schema.names), "batch")
    highest = F.coalesce(F.max("id").cast("bigint"), F.lit(first - 1)) if "id" in schema.names else F.lit(0)
    mark = batch.agg(F.greatest(highest, F.lit(first - 1)).cast("bigint").alias("last"))
    mark.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(f"{path}_marks")
    day = F.to_date(DAY_OF.get(table, "date"))
    day = F.trunc(day, "month") if table in MONTHLY else day
    rows = batch.withColumns({BATCH: F.lit(batch_id), DAY: day}).hint("rebalance", DAY)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, DAY).parquet(path)
    return batch


def _first_id(spark: SparkSession, path: str, batch_id: int) -> int:
    """One above the last id of all earlier batches: the marks hold a row per batch."""
    schema = "last bigint, batch int"
    try:
        marks = spark.read.schema(schema).parquet(f"{path}_marks")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 1
    return (marks.filter(F.col("batch") < batch_id).agg(F.max("last")).first()[0] or 0) + 1


def save_daily_log(daily: DataFrame, path: str) -> DataFrame:
    """Upsert counters by user and date; returns the days as they stand now.

    The days in hand are read, merged and replaced as partitions. Rows of users
    who are not in the batch stay, and so do all other days. Of several rows of
    one key in the batch the highest counters count.
    """
    spark = daily.sparkSession
    columns = schemas.DAILY_LOG.names
    key = ["user_id", "date"]
    counts = [F.max(c).alias(c) for c in columns if c not in key]
    new = durable(daily.groupBy(*key).agg(*counts), "upsert")
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        whole = new
    else:
        days = new.select(F.col("date").alias(DAY)).distinct()
        # Dynamic pruning: only the partitions of these days are read.
        there = stored.join(F.broadcast(days), DAY, "left_semi") if days.count() <= MOST_DAYS else stored.join(days, DAY, "left_semi")
        kept = there.select(*columns).join(new.select(*key), key, "left_anti")
        whole = durable(kept.unionByName(new.select(*columns)), "upsert")
    whole = whole.select(*columns)
    whole.withColumn(DAY, F.col("date")).hint("rebalance", DAY).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(DAY).parquet(path)
    return whole


#: A list of this many days, a few hundred kilobytes, is sent to the readers.
MOST_DAYS = 40_000
