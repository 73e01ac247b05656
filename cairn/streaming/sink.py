"""Streams into plain parquet: each micro-batch is a partition of its own.

``write_changes`` stores rows that replace older ones, and readers keep the
newest per key. ``write_sums`` stores what a batch adds per key, and readers add
up. A batch that is tried again overwrites its own partition only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.session import new_folder, remove

BATCH = "batch_id"
# Folders that readers of the batches pass over: versions of what is live, and batches put together.
LIVE, MERGED = "_live", "_merged"


def _start(rows: DataFrame, store, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(store)
        .start()
    )


def write_changes(
    changes: DataFrame, path: str, checkpoint: str, mode: str = "update", trigger: dict | None = None
) -> StreamingQuery:
    """Start a stream that stores each batch's rows under ``batch_id=N``.

    ``trigger`` is that of ``DataStreamWriter``, such as ``{"processingTime": "1
    minute"}`` for a stream that keeps running; by default it ends when all
    input is read.
    """
    return _start(
        changes, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}"),
        checkpoint, mode, trigger,
    )


def write_sums(
    rows: DataFrame, keys: list[str], values: list[str], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start a stream that stores the sums of each batch per key.

    There is no state and no watermark: a row that comes weeks late is added
    like any other.
    """

    def store(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        sums.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return _start(rows, store, checkpoint, "append", trigger)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def manifest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(upto, folder): batches below ``upto`` are put together in ``folder``; (0, None) if none are.

    Each version is a file that appears by one rename; the highest counts.
    """
    files, place = _files(spark, f"{path}/{LIVE}")
    if not files.exists(place):
        return 0, None
    names = [s.getPath().getName() for s in files.listStatus(place)]
    versions = sorted(int(n.split("-")[1]) for n in names if n.startswith("version-"))
    if not versions:
        return 0, None
    last = spark.read.json(f"{path}/{LIVE}/version-{versions[-1]}", schema="upto bigint, folder string").first()
    return last["upto"], last["folder"]


def _swap(spark: SparkSession, path: str, upto: int, folder: str) -> None:
    """Let readers follow ``folder`` from now on: written aside first, then renamed."""
    line = json.dumps({"upto": upto, "folder": folder}).encode()
    files, place = _files(spark, f"{path}/{LIVE}")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    number = max([int(n.split("-")[1]) for n in names if n.startswith("version-")], default=0) + 1
    _, aside = _files(spark, f"{path}/{LIVE}/_{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(line))
    out.close()
    if not files.rename(aside, _files(spark, f"{path}/{LIVE}/version-{number}")[1]):
        raise OSError(f"version {number} of {path} was written by somebody else")


def _clear(spark: SparkSession, path: str) -> None:
    """Remove what no reader follows any more; may be broken off and tried again."""
    upto, folder = manifest(spark, path)
    files, place = _files(spark, path)
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < upto:
            remove(spark, f"{path}/{name}")
    files, place = _files(spark, f"{path}/{MERGED}")
    for status in files.listStatus(place) if files.exists(place) else []:
        if status.getPath().getName() != folder:
            remove(spark, f"{path}/{MERGED}/{status.getPath().getName()}")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    upto, folder = manifest(spark, path)
    live = spark.read.schema(f"{schema}, {BATCH} bigint").option("basePath", path).parquet(path)
    if folder is None:
        return live
    merged = spark.read.schema(schema).parquet(f"{path}/{MERGED}/{folder}")
    return live.filter(F.col(BATCH) >= upto).unionByName(merged.withColumn(BATCH, F.lit(upto - 1).cast("bigint")))


def read_current(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest stored row per key."""
    stored = _stored(spark, path, schema)
    values = [c for c in stored.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*values), BATCH).alias("v")
    return stored.groupBy(*keys).agg(newest).select(*keys, "v.*")


def read_sums(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The sums of all batches per key."""
    stored = _stored(spark, path, schema)
    values = [c for c in stored.columns if c not in (*keys, BATCH)]
    return stored.groupBy(*keys).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored rows of a stream in append mode."""
    return _stored(spark, path, schema).drop(BATCH)


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int, sums: bool = False) -> None:
    """Put the batches before ``upto`` together, to be run while no reader is at work.

    The rows are written to a folder of their own, one rename makes readers
    follow it, and only then the old folders go. Readers give the same rows
    after any of these steps, so a run that breaks off harms nothing and the
    next one clears up behind it. Batches from ``upto`` on, which may still be
    written, stay as they are; earlier ones must be complete.
    """
    if upto > manifest(spark, path)[0]:
        old = _stored(spark, path, schema).filter(F.col(BATCH) < upto)
        values = [c for c in old.columns if c not in (*keys, BATCH)]
        if sums:
            merged = old.groupBy(*keys).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])
        else:
            newest = F.max_by(F.struct(*values), BATCH).alias("v")
            merged = old.groupBy(*keys).agg(newest).select(*keys, "v.*")
        folder = f"upto-{upto}-{uuid.uuid4().hex}"
        _merge(merged, f"{path}/{MERGED}/{folder}")
        _swap(spark, path, upto, folder)
    _clear(spark, path)


def _merge(merged: DataFrame, folder: str) -> None:
    merged.write.parquet(folder)


def run_available(changes: DataFrame, label: str, mode: str = "update") -> str:
    """Run a stream over all input there is and return the folder with its rows."""
    path, progress = new_folder(changes.sparkSession, label), new_folder(changes.sparkSession, f"{label}-progress")
    write_changes(changes, path, progress, mode).awaitTermination()
    return path


def run_sums(rows: DataFrame, label: str, keys: list[str], values: list[str]) -> str:
    """Sum up all input there is and return the folder with the sums."""
    path, progress = new_folder(rows.sparkSession, label), new_folder(rows.sparkSession, f"{label}-progress")
    write_sums(rows, keys, values, path, progress).awaitTermination()
    return path
