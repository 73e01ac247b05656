"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import durable

BLOCK_ROWS = 100_000
PIECE_BYTES = 1 << 20


def documents(spark, folder: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that the frame does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(batch: pa.RecordBatch, columns: str | Sequence[str], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text ``columns`` hold about ``limit`` bytes at most, one row at least.

    What a task keeps beside its Arrow batch is then bounded by the longest
    text instead of by 10,000 rows of any length.
    """
    names = [columns] if isinstance(columns, str) else columns
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
    begin, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: Rows of an Arrow batch where rows are whole texts.
TEXT_ROWS = 1_000


def short_batches(spark) -> None:
    """Let Python workers get batches of ``TEXT_ROWS`` rows at most, for plans that run from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def numbered(df: DataFrame, group: Sequence[str], name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no promised order.

    Equal rows are counted first and fanned out last, so one row repeated a
    billion times is one row until the end. A group is cut into blocks by the
    hash of its rows: the first row number of a block comes from a running sum
    over block counts (one row per ``block_rows`` rows), and no task sees more
    than a block. Group columns must not be null. The counted rows are written
    down, as the numbers rest on two reads of them.
    """
    columns = df.columns
    count, block, first = (free_name(df, n) for n in ("_count", "_block", "_first"))
    rows = durable(df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)), "numbered")
    blocks = max(16, -(-rows.count() // block_rows))
    rows = rows.withColumn(block, F.pmod(F.xxhash64(*columns), F.lit(blocks)))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        rows.groupBy(*group, block)
        .agg(F.sum(count).alias(first))
        .withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    )
    inside = Window.partitionBy(*group, block).orderBy(*[c for c in columns if c not in group])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(first) + F.coalesce(F.sum(count).over(inside), F.lit(0))
    return rows.join(begins, [*group, block]).select(
        *columns, start.alias(first), count
    ).select(
        *columns,
        F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1)).alias(name),
    )


#: Bits of a filter of ids; 4 MB whatever the number of ids.
FILTER_BITS = 1 << 25


def likely(df: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose ``column`` is, or by chance looks like, one of the ids (one column of the same type).

    A Bloom filter of fixed size is put together in Spark and handed to the
    tasks. It keeps rows that a join would drop anyway from being shuffled;
    with very many ids it lets all rows pass and is of no harm. To be followed
    by that join.
    """
    h = F.xxhash64(F.col(ids.columns[0]))
    spots = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 31), F.lit(bits)))).alias("spot")
    words = ids.select(spots).groupBy(F.expr("spot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")
    ).toPandas()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    @F.pandas_udf("boolean")
    def there(hashed: pd.Series) -> pd.Series:
        found, one = hashed.to_numpy(np.int64), np.int64(1)
        hit = np.ones(len(found), bool)
        for spot in (np.mod(found, bits), np.mod(found >> 31, bits)):
            hit &= (table[spot >> 6] >> (spot & 63)) & one == one
        return pd.Series(hit)

    return df.filter(there(F.xxhash64(F.col(column))))
