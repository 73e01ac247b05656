"""Message lists kept as bullet points in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import LINE_END, strip


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every line of every text with its number: ``(key, line_no, line)``."""
    return texts.select(key, F.posexplode(F.split(text, LINE_END)).alias("line_no", "line"))


def bullets(numbered: DataFrame, prefix: str = "- ") -> DataFrame:
    """Lines that are bullets once stripped, without the marker; empty ones drop out."""
    bare = strip(F.col("line"))
    message = strip(F.substring(bare, 3, 2_147_483_647))
    return (
        numbered.filter(F.startswith(bare, F.lit(prefix)))
        .withColumn("message", message)
        .filter(F.col("message") != "")
        .drop("line")
    )


def message_corpus(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """Messages of the Markdown files at ``path``; the fallback when there are none.

    ``fallback`` has a column ``message``. Whole files are read, however long,
    as plain lines that split between tasks.
    """
    file_system = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = file_system.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(file_system)
    if found is None or len(found) == 0:
        return fallback.select("message")
    read = spark.read.text(path).withColumnRenamed("value", "line")
    messages = bullets(read).select("message")
    return or_fallback(messages, fallback.select("message"))


def or_fallback(messages: DataFrame, fallback: DataFrame) -> DataFrame:
    """The messages, or the fallback when there is not one."""
    return fallback if messages.isEmpty() else messages
