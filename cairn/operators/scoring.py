"""Scoring of questionnaires and reaction tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.catalogue import (
    AVG_TIME_KEY, BDEFS, BDEFS_DOMAINS, BISBAS, BISBAS_DOMAINS, RESPONSE_MAX, RESPONSE_MIN,
    STROOP, total_max,
)
from cairn.functions.columns import percent, strip

RESULT = ["id", "user_id", "type", "taken_at"]


def questionnaire_max(kind: Column) -> Column:
    """Constant maximum of a questionnaire, whichever items were answered."""
    return F.when(kind == BDEFS, total_max(BDEFS)).when(kind == BISBAS, total_max(BISBAS))


_NAMES = (*BDEFS_DOMAINS, *BISBAS_DOMAINS)


def score_questionnaire(answers: DataFrame, validated: bool = False) -> DataFrame:
    """Results from item rows ``(assessment_id, user_id, taken_at, type, domain, response)``.

    One hash aggregation with a sum per catalogue domain, combined before its
    only shuffle. Names outside the catalogue count like any other; they are
    gathered in a side branch that filters the answers once more. ``validated``
    tells that the answers passed their check, which refuses such names, and
    leaves the branch out.
    """
    domain, response = F.col("domain"), F.col("response")
    placed = answers.withColumnRenamed("assessment_id", "id")
    sums = [
        F.sum(F.when(domain == name, response)).cast("int").alias(f"_sum{place}")
        for place, name in enumerate(_NAMES)
    ]
    whole = placed.groupBy(*RESULT).agg(F.sum("response").cast("int").alias("score"), *sums)
    pairs = [
        F.struct(F.lit(name).alias("name"), F.col(f"_sum{place}").alias("score"))
        for place, name in enumerate(_NAMES)
    ]
    entries = F.filter(F.array(*pairs), lambda e: e["score"].isNotNull())
    if not validated:
        other = placed.filter(~F.coalesce(domain.isin(*_NAMES), F.lit(False)))
        more = other.groupBy(*RESULT, "domain").agg(F.sum("response").cast("int").alias("_sum")).groupBy(*RESULT).agg(
            F.sort_array(F.collect_list(F.struct(domain.alias("name"), F.col("_sum").alias("score")))).alias("_more")
        )
        same = F.lit(True)
        for key in RESULT:
            same = same & F.col(f"w.{key}").eqNullSafe(F.col(f"m.{key}"))
        whole = whole.alias("w").join(more.alias("m"), same, "left").select("w.*", "_more")
        entries = F.concat(entries, F.coalesce("_more", F.array().cast("array<struct<name:string,score:int>>")))
    return whole.select(
        *RESULT,
        "score",
        questionnaire_max(F.col("type")).alias("max_score"),
        F.map_from_entries(entries).alias("domain_scores"),
    )


def score_answer_map(rows: DataFrame) -> DataFrame:
    """Results from one row per assessment with ``answers MAP<domain, ARRAY<INT>>``.

    Needs no shuffle at all.
    """
    sums = F.transform_values(
        "answers", lambda _, items: F.aggregate(items, F.lit(0), lambda a, x: a + x)
    )
    total = F.aggregate(F.map_values("domain_scores"), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("domain_scores", sums).select(
        *RESULT,
        total.alias("score"),
        questionnaire_max(F.col("type")).alias("max_score"),
        "domain_scores",
    )


def trial_correct() -> Column:
    """A trial is right when the stripped, lower-cased answer is the ink colour."""
    return F.coalesce(F.lower(strip(F.col("answer"))) == F.col("ink_colour"), F.lit(False))


def score_stroop(trials: DataFrame) -> DataFrame:
    """Results from trial rows; times are whole milliseconds, so no order matters.

    The average is truncated, as an integer division.
    """
    counted = trials.groupBy(
        F.col("assessment_id").alias("id"), "user_id", F.lit(STROOP).alias("type"), "taken_at"
    ).agg(
        F.count(F.lit(1)).cast("int").alias("trials"),
        F.count_if(trial_correct()).cast("int").alias("correct"),
        F.sum(F.col("elapsed_ms").cast("bigint")).alias("total_ms"),
    )
    avg = F.expr("total_ms div trials").cast("int")
    scores = F.create_map(
        F.lit("correct"), F.col("correct"), F.lit("trials"), F.col("trials"),
        F.lit(AVG_TIME_KEY), avg,
    )
    return counted.select(
        *RESULT,
        F.col("correct").alias("score"),
        F.col("trials").alias("max_score"),
        scores.alias("domain_scores"),
    )


def stroop_accuracy(trials: DataFrame) -> DataFrame:
    """Accuracy and mean seconds per reaction test, 0 without trials."""
    counted = trials.groupBy("assessment_id", "user_id").agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(trial_correct()).alias("correct"),
        F.sum("elapsed_ms").alias("total_ms"),
    )
    return counted.select(
        "assessment_id",
        "user_id",
        "trials",
        "correct",
        percent(F.col("correct"), F.col("trials")).alias("accuracy_pct"),
        F.when(F.col("trials") > 0, F.col("total_ms") / 1000 / F.col("trials"))
        .otherwise(0.0).alias("avg_time_s"),
    )


def mean_domain_scores(results: DataFrame) -> DataFrame:
    """Sum per domain over the number of *all* results of the user.

    Each result adds one marker row, so the count rides along in the same
    aggregation; what is windowed afterwards is a few domain rows per user.
    """
    marker = F.array(F.struct(F.lit(None).cast("string").alias("domain"), F.lit(0).alias("score")))
    pairs = F.transform(
        F.map_entries("domain_scores"),
        lambda e: F.struct(e["key"].alias("domain"), e["value"].alias("score")),
    )
    rows = results.select("user_id", F.explode(F.concat(marker, pairs)).alias("e"))
    sums = rows.groupBy("user_id", F.col("e.domain").alias("domain")).agg(
        F.sum("e.score").alias("total"), F.count(F.lit(1)).alias("n")
    )
    results_of_user = F.sum(F.when(F.col("domain").isNull(), F.col("n"))).over(
        Window.partitionBy("user_id")
    )
    return (
        sums.withColumn("results", results_of_user)
        .filter(F.col("domain").isNotNull())
        .select("user_id", "domain", (F.col("total") / F.col("results")).alias("mean_score"))
    )


def questionnaire_limits(items: DataFrame) -> DataFrame:
    """Item count, floor, maximum and range per type and domain, with a total per type.

    ``items`` has one row per item: ``(type, domain)``.
    """
    per = items.rollup("type", "domain").agg(
        F.count(F.lit(1)).alias("items"), F.grouping_id().alias("level")
    )
    return per.filter(F.col("type").isNotNull()).select(
        "type",
        "domain",
        "items",
        (F.col("items") * RESPONSE_MIN).alias("floor_score"),
        (F.col("items") * RESPONSE_MAX).alias("max_score"),
        (F.col("items") * (RESPONSE_MAX - RESPONSE_MIN)).alias("score_range"),
    )


def explode_domains(results: DataFrame) -> DataFrame:
    """One row per domain of the questionnaire results."""
    kinds = results.filter(F.col("type").isin(BDEFS, BISBAS))
    return kinds.select(
        *RESULT, F.explode("domain_scores").alias("domain", "domain_score")
    )

