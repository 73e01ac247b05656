"""Joins of values with the ranges they lie in, without an equality between the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import durable


def interval_join(
    points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str,
    keys: Sequence[str] = (), name: str = "range",
) -> DataFrame:
    """Every row of ``points`` once per range with ``lo < value <= hi``, or once with null if there is none.

    The range is a struct of all its columns under ``name``. ``keys`` are columns
    of both that must be equal too. Ranges may overlap, repeat and be open ended
    (infinite); values are numbers. Null and NaN values, null keys and ranges
    with a null or NaN bound or without extent match nothing.

    A comparison alone would plan as a nested loop. Here a range is put into the
    cells of a grid whose cells are as wide as itself or up to twice as wide, so
    two cells hold it, and a value asks one cell of every grid that some range
    uses. Grids are powers of two, so their number is bounded by the exponents
    of a double, whatever the number of ranges. Distinct values are joined, so a
    value that a third of the rows share asks once; rows find their value again
    by equality, where adaptive execution may split the rows of a hot one.
    """
    if name in points.columns:
        raise ValueError(f"points have a column {name} already")
    named = [f"_k{place}" for place in range(len(keys))]
    picked = [F.col(key).alias(as_) for key, as_ in zip(keys, named)]
    number = F.col("_v").cast("double")
    asked = points.select(*picked, F.col(value).alias("_v")).filter(number.isNotNull() & ~F.isnan(number))
    values = durable(asked.distinct(), "values")
    finite = F.when(F.abs(number) < float("inf"), number)
    least, most = (end or 0.0 for end in values.agg(F.min(finite), F.max(finite)).first())
    offered = ranges.select(
        *picked, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.struct(*ranges.columns).alias("_range")
    )

    def within(end: Column) -> Column:
        """Cut to the span of the values: nothing is asked beyond it, so open ends are as wide as that."""
        return F.least(F.greatest(end.cast("double"), F.lit(least)), F.lit(most))

    low, high = within(F.col("_lo")), within(F.col("_hi"))
    wide = F.coalesce(F.ceil(F.log2(F.when(high > low, high - low))), F.lit(0))
    begin, end = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    reached = (end >= least) & ((begin <= most) | (end == float("inf")))
    fits = (F.col("_lo") < F.col("_hi")) & ~F.isnan(end) & reached
    graded = durable(offered.filter(fits).withColumn("_level", F.least(wide, F.lit(1023)).cast("int")), "ranges")
    levels = sorted(row[0] for row in graded.select("_level").distinct().collect())

    size = F.pow(F.lit(2.0), F.col("_level"))
    ranged = graded.withColumn("_cell", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    grids = F.array(*[F.lit(one) for one in levels]).cast("array<int>")
    asking = values.withColumn("_level", F.explode(grids)).withColumn("_cell", F.floor(within(F.col("_v")) / size))
    inside = (F.col("_v") > F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    found = asking.join(ranged, [*named, "_level", "_cell"]).filter(inside).select(*named, "_v", "_range")

    same = F.col(f"p.{value}") == F.col("m._v")
    for key, as_ in zip(keys, named):
        same = same & (F.col(f"p.{key}") == F.col(f"m.{as_}"))
    whole = points.alias("p").join(found.alias("m"), same, "left")
    return whole.select("p.*", F.col("m._range").alias(name))
