"""Sessions for tests and benchmarks, and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_FOLDER = "cairn.local.folder"
RUN_FOLDER = "cairn.run.folder"


def local_session(cores: int | str = "*", name: str = "cairn") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    Only a local master may do without that setting: it gets a folder of its
    own, which goes when the process ends.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(LOCAL_FOLDER, None)
    if folder is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(LOCAL_FOLDER, folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all intermediate tables made in the block; it is removed at the end.

    Results are lazy and read those tables: write or collect them inside.
    """
    outer = spark.conf.get(RUN_FOLDER, None)
    path = f"{shared_folder(spark)}/cairn-run-{uuid.uuid4().hex}"
    spark.conf.set(RUN_FOLDER, path)
    try:
        yield path
    finally:
        if outer is None:
            spark.conf.unset(RUN_FOLDER)
        else:
            spark.conf.set(RUN_FOLDER, outer)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables; the one place that asks the file system itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder of the run, or else under the shared folder."""
    base = spark.conf.get(RUN_FOLDER, None) or shared_folder(spark)
    return f"{base}/cairn-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    This cuts the lineage, fixes generated positions for good, survives lost
    executors and gives the planner exact sizes for its join choices. The table
    lives as long as its run, see ``run_folder``.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``durable`` wrote; only once all that was made of it has been written itself."""
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        if not os.path.basename(folder).startswith("cairn-"):
            raise ValueError(f"not an intermediate table: {folder}")
        remove(df.sparkSession, folder)
