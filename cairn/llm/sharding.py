"""Shards by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no
ring table is kept, and one more shard takes its share of rows from all others
while every other row stays (Lamping and Veach, 2014).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import numbered, text_or_empty

#: Fixed values of the published generator.
MULTIPLIER, SPAN, SHIFT = 2862933555777941757, 1 << 31, 33


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. A key leaps forward through the shards it would have moved to."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = keys.astype(np.int64).view(np.uint64).copy()
    place = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    landing = np.zeros(len(state), np.int64)
    while going.size:
        place[going] = landing
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[going] >> np.uint64(SHIFT)).astype(np.float64) + 1.0
        landing = ((place[going] + 1) * (SPAN / draw)).astype(np.int64)
        stay = landing < shards
        going, landing = going[stay], landing[stay]
    return place.astype(np.int32)


def shard_of(keys: Sequence[Column | str], shards: int) -> Column:
    """Shard of a row by its key columns; a null key is a key like any other."""

    def shard(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards))

    return F.pandas_udf(shard, "int")(F.xxhash64(*keys))


def assign(df: DataFrame, keys: Sequence[str], shards: int, name: str = "shard") -> DataFrame:
    """All rows and columns with their shard, without a shuffle.

    Rows of one key always share a shard, as the law demands, whatever they
    hold. An existing column of that name is refused.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows already have a column {name}")
    return df.withColumn(name, shard_of(keys, shards))


def write(df: DataFrame, path: str, keys: Sequence[str], shards: int, files: int = 1) -> None:
    """Write one folder per shard, each in up to ``files`` files per hash of the rest of a row.

    Raise ``files`` with the size of a shard: a shard is never one task's work.
    """
    placed = assign(df, keys, shards)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    placed.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(path)


def manifest(docs: DataFrame, shards: int) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot in the shard, grown_shard.

    Law is ``key``: doc_id and the shard count decide, ``grown_shard`` is the
    shard with one shard more. Size is the text's UTF-8 bytes plus 1, a null
    text has none and the checksum 0. A null doc_id is a key of its own.
    Repeated rows each get a slot; an empty table gives no rows; other columns
    are not read.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(["doc_id"], shards).alias("shard"),
        shard_of(["doc_id"], shards + 1).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], "slot")
