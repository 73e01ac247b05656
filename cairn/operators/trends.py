"""Least-squares trend of scores over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.catalogue import BDEFS
from cairn.functions.columns import MICROS_PER_DAY, micros
from cairn.session import durable


def trend_fit(results: DataFrame, kind: str = BDEFS) -> DataFrame:
    """Fitted score per result, for users with at least two results of the type.

    Users whose results all fall on one instant have no line: the fit is null.

    The sums behind a line combine before the shuffle. Lines are then written
    down, one small row per user, so that the join back to the results reads
    both sides from plain shuffles: the planner broadcasts the lines if they are
    small, and otherwise splits the users that hold very many results.
    """
    days = micros(F.col("taken_at")).cast("double") / MICROS_PER_DAY
    points = results.filter(F.col("type") == kind).select(
        "user_id", "id", "taken_at", "score", days.alias("x")
    )
    score = F.col("score").cast("double")
    lines = points.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope(score, F.col("x")).alias("slope"),
        F.regr_intercept(score, F.col("x")).alias("intercept"),
    )
    fitted = points.join(durable(lines.filter(F.col("points") >= 2), "lines"), "user_id")
    return fitted.select(
        "user_id", "id", "taken_at", "score", "points", "slope", "intercept",
        (F.col("slope") * F.col("x") + F.col("intercept")).alias("fitted"),
    )
