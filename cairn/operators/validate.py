"""Constraint checks: every table splits into valid rows and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.catalogue import (
    ASSESSMENT_TYPES, BDEFS, BDEFS_DOMAINS, BISBAS, BISBAS_DOMAINS, COLOURS, JOURNAL_LIMITS,
    MINUTES_MAX, RESPONSE_MAX, RESPONSE_MIN, TASK_STATUSES, TITLE_MAX,
)
from cairn.functions.columns import present, strip

Rules = dict[str, Column]


def task_rules() -> Rules:
    """Title of 1..500 characters and a known status."""
    return {
        "title_length": F.length("title").between(1, TITLE_MAX),
        "status_unknown": F.col("status").isin(*TASK_STATUSES),
    }


def session_rules() -> Rules:
    """Focus sessions of 1..120 minutes."""
    return {"duration_range": F.col("duration_minutes").between(1, MINUTES_MAX)}


def daily_log_rules() -> Rules:
    """Counters are never negative."""
    return {
        "tasks_negative": F.col("tasks_completed") >= 0,
        "minutes_negative": F.col("focus_minutes") >= 0,
    }


def assessment_rules() -> Rules:
    """Known type, score at least 0, maximum above 0."""
    return {
        "type_unknown": F.col("type").isin(*ASSESSMENT_TYPES),
        "score_negative": F.col("score") >= 0,
        "max_not_positive": F.col("max_score") > 0,
    }


def journal_rules() -> Rules:
    """Five texts, none empty once stripped, none too long."""
    return {
        f"{name}_length": F.length(strip(F.col(name))).between(1, limit)
        for name, limit in JOURNAL_LIMITS.items()
    }


def answer_rules() -> Rules:
    """Responses from 1 to 4, to domains of the questionnaire."""
    known = F.when(F.col("type") == BDEFS, F.col("domain").isin(*BDEFS_DOMAINS)).when(
        F.col("type") == BISBAS, F.col("domain").isin(*BISBAS_DOMAINS)
    )
    return {
        "response_range": F.col("response").between(RESPONSE_MIN, RESPONSE_MAX),
        "domain_unknown": known,
    }


def trial_rules() -> Rules:
    """The word never names its own ink colour."""
    return {
        "word_is_ink": F.col("word") != F.col("ink_colour"),
        "colour_unknown": F.col("ink_colour").isin(*COLOURS),
    }


def timer_plan_rules() -> Rules:
    """Planned minutes from 1 to 120."""
    return {"plan_range": F.col("planned_minutes").between(1, MINUTES_MAX)}


def reasons(rules: Rules) -> Column:
    """Names of the rules a row breaks; a rule that cannot be judged is broken."""
    return present(
        [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    )


def check(rows: DataFrame, rules: Rules) -> DataFrame:
    """Add ``reasons``, empty for a valid row."""
    return rows.withColumn("reasons", reasons(rules))


def valid(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break no rule."""
    return check(rows, rules).filter(F.size("reasons") == 0).drop("reasons")


def rejected(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break a rule, with the reasons."""
    return check(rows, rules).filter(F.size("reasons") > 0)


def strip_journal(rows: DataFrame) -> DataFrame:
    """The five journal texts without surrounding white space."""
    return rows.withColumns({name: strip(F.col(name)) for name in JOURNAL_LIMITS})
