"""Encouragement messages: which one a user sees on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import ordered
from cairn.session import durable


def dedup_keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order.

    Duplicates combine before the shuffle, so a row copied into a third of the
    table costs no more than any other.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, "first.*")


def number_messages(messages: DataFrame, order: list[str], **sizes: int) -> DataFrame:
    """Number the messages 0, 1, 2, ... in the given order."""
    return ordered.number(messages, order, "number", **sizes)


def pick_number(user: Column, day: Column, n: Column) -> Column:
    """A repeatable pseudo-random number below ``n`` per user and day."""
    days = F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.pmod(user * 7919 + days * 104729, n)


def assign_nudge(users_days: DataFrame, numbered: DataFrame) -> DataFrame:
    """One message per row of ``(user_id, date)``; no rows when there are no messages.

    ``numbered`` comes from :func:`number_messages`. The choice depends on user
    and day only, so a rerun gives the same message.
    """
    catalogue = durable(numbered, "messages")
    n = catalogue.count()
    if n == 0:
        none = {"number": F.lit(0).cast("bigint"), "message": F.lit("")}
        return users_days.withColumns(none).filter(F.lit(False))
    number = pick_number(F.col("user_id"), F.col("date"), F.lit(n))
    return users_days.withColumn("number", number).join(
        catalogue.select("number", "message"), "number"
    )
