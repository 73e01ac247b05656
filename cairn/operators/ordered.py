"""Running values along an order, safe for keys that hold most of the rows.

A plain window sends all rows of a key to one task. Here keys above ``limit``
rows take another way with the same result: the rows are range-partitioned by
key *and* order, so a large key is spread over many tasks, cut into chunks of
consecutive rows, scanned chunk by chunk, and joined with what the earlier
chunks carry over (one small row per chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import durable

PLAIN_LIMIT = 1_000_000
CHUNK_ROWS = 200_000


@dataclass(frozen=True)
class Running:
    """One running value: ``total``, ``latest`` known or ``previous`` row's."""

    kind: str
    value: Column


def total(value: Column) -> Running:
    """Sum up to and including the row."""
    return Running("total", value)


def latest(value: Column) -> Running:
    """Last value that is not null, up to and including the row."""
    return Running("latest", value)


def previous(value: Column) -> Running:
    """Value on the row before, null on a key's first row."""
    return Running("previous", value)


def large_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: at most one per ``limit`` rows of input.

    Counts are combined before the shuffle, so a large key costs nothing extra.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > limit).select(*keys)


def by_key_size(
    df: DataFrame,
    keys: Sequence[str],
    limit: int,
    plain: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``plain`` for ordinary keys, ``spread`` for the large ones, results together.

    Null keys count as one key. The list of large keys, if there are any, is a
    written table of known size, so the planner itself decides whether to
    broadcast it. The input is read twice: pass a stored table, not a long
    derivation.
    """
    large = large_keys(df, keys, limit)
    if large.isEmpty():
        return plain(df)
    large = durable(large, "large-keys")
    marked = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_large_{k}"))
    rest = plain(df.join(marked, same, "left_anti"))
    return rest.unionByName(spread(df.join(marked, same, "left_semi")))


def placed(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rows: int
) -> DataFrame:
    """Add ``_pos`` (rank-preserving number) and ``_chunk`` (``rows`` rows at most).

    ``order`` must settle every tie. Positions are drawn while sorting and must
    never be drawn twice: for one reader that is written, or by :func:`chunked`.
    """
    sort = [*keys, *order]
    numbered = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return numbered.withColumn("_chunk", F.expr(f"_pos div {rows}"))


def chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rows: int
) -> DataFrame:
    """The rows of :func:`placed` written down, for any number of readers."""
    return durable(placed(df, keys, order, rows), "chunks")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    limit: int | None = PLAIN_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
    **outputs: Running,
) -> DataFrame:
    """Add one column per output, running along ``order`` within ``keys``.

    A limit of None says that the caller knows all keys to be small.
    """
    if limit is None:
        return _scan_plain(df, keys, order, outputs)
    return by_key_size(
        df,
        keys,
        limit,
        lambda part: _scan_plain(part, keys, order, outputs),
        lambda part: _scan_chunks(part, keys, order, outputs, chunk_rows),
    )


def _over(run: Running, window: Window) -> Column:
    if run.kind == "previous":
        return F.lag(run.value).over(window)
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if run.kind == "total":
        return F.sum(run.value).over(frame)
    return F.last(run.value, ignorenulls=True).over(frame)


def _scan_plain(df, keys, order, outputs) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({name: _over(run, window) for name, run in outputs.items()})


def _scan_chunks(df, keys, order, outputs, rows) -> DataFrame:
    columns = df.columns
    inputs = {f"_in_{name}": run.value for name, run in outputs.items()}
    placed = chunked(df.withColumns(inputs), keys, order, rows)
    inside = {name: Running(run.kind, F.col(f"_in_{name}")) for name, run in outputs.items()}

    window = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    local = placed.withColumns(
        {f"_local_{name}": _over(run, window) for name, run in inside.items()}
    ).withColumn("_first", F.lag(F.lit(1)).over(window).isNull())

    ends = {}
    for name, run in inside.items():
        if run.kind == "total":
            ends[name] = F.sum(run.value)
        else:
            # The position may only skip nulls for "latest".
            at = F.when(run.value.isNotNull(), F.col("_pos")) if run.kind == "latest" else F.col("_pos")
            ends[name] = F.max_by(run.value, at)
    summary = placed.groupBy(*keys, "_chunk").agg(
        *[end.alias(f"_end_{name}") for name, end in ends.items()]
    )
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_chunk").alias("_of_chunk"),
        *[_carry(run.kind, F.col(f"_end_{name}"), chunks, before).alias(f"_carry_{name}")
          for name, run in inside.items()],
    )
    same = F.col("_chunk") == F.col("_of_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = local.join(carried, same, "left")
    return joined.select(
        *columns, *[_combine(run.kind, name).alias(name) for name, run in inside.items()]
    )


def _carry(kind: str, end: Column, chunks: Window, before: Window) -> Column:
    if kind == "total":
        return F.sum(end).over(before)
    if kind == "latest":
        return F.last(end, ignorenulls=True).over(before)
    return F.lag(end).over(chunks)


def _combine(kind: str, name: str) -> Column:
    local, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
    if kind == "total":
        both = local + carry
        return F.coalesce(both, local, carry)
    if kind == "latest":
        return F.coalesce(local, carry)
    return F.when(F.col("_first"), carry).otherwise(local)


def number(
    df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number all rows from ``start`` in the given order, without one task seeing them all.

    The window at the end runs over one row per chunk.
    """
    placed = chunked(df, [], order, chunk_rows)
    counts = placed.groupBy("_chunk").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_low")
    )
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "_chunk", "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begin")
    )
    place = F.lit(start) + F.col("_begin") + F.col("_pos") - F.col("_low")
    return placed.join(begins, "_chunk").select(*df.columns, place.cast("bigint").alias(name))
