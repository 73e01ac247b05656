"""Small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND

# What counts as white space and as a line end.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` in that order, 0 for a whole of 0."""
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))


def score_of(scores: Column, domain: str) -> Column:
    """One entry of a score map, 0 when it is missing."""
    return F.coalesce(F.try_element_at(scores, F.lit(domain)), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(text, F.lit(SPACES))


def present(codes: list[Column]) -> Column:
    """The codes that apply, in order, as an array without gaps."""
    return F.array_compact(F.array(*codes))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts) * MICROS_PER_SECOND
    return days * MICROS_PER_DAY + minutes.cast("bigint") * 60 * MICROS_PER_SECOND + seconds.cast(
        "bigint"
    )


def from_micros(value: Column) -> Column:
    """Inverse of :func:`micros`."""
    zero = F.lit(0)
    seconds = (value.cast("decimal(18,0)") / MICROS_PER_SECOND).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds
    )


def week_start(day: Column) -> Column:
    """Monday of the day's week."""
    return F.date_sub(day, F.weekday(day))
