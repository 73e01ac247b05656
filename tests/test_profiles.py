"""Personalisation rules against hand-traced values."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import profiles
from tests.helpers import ASSESSMENTS, at, bisbas, rows


def latest(spark, *results):
    data = [
        (i, 1, kind, at("2024-01-01"), score, whole, scores)
        for i, (kind, score, whole, scores) in enumerate(results)
    ]
    return profiles.latest_three_types(spark.createDataFrame(data, ASSESSMENTS))


def blended(spark, *results):
    row = profiles.profile_blended(latest(spark, *results)).first()
    return tuple(row)[1:]


def own(spark, scores):
    row = profiles.profile_latest_bisbas(latest(spark, ("bisbas", 40, 80, scores))).first()
    return tuple(row)[1:]


def stroop(correct, ms):
    scores = {"correct": correct, "trials": 10}
    return ("stroop", correct, 10, scores if ms is None else {**scores, "avg_time_ms": ms})


def test_defaults_without_bisbas(spark):
    row = profiles.profile_latest_bisbas(latest(spark, ("bdefs", 30, 60, {}))).first()
    assert tuple(row)[1:] == (15, 5, "balanced", False, False, False)


@pytest.mark.parametrize(
    "scores,expected",
    [
        (bisbas(20, 8, 8, 8), (10, 6, "reassuring", True, False, True)),
        ({}, (10, 6, "balanced", True, False, False)),
        (bisbas(12, 12, 12, 15), (12, 6, "balanced", False, False, False)),
        (bisbas(10, 15, 15, 10), (20, 5, "reward", False, True, False)),
        (bisbas(10, 15, 15, 15), (12, 6, "reward", False, True, False)),
        (bisbas(14, 11, 14, 14), (15, 5, "balanced", False, False, False)),
        (bisbas(15, 15, 15, 10), (10, 6, "reassuring", True, True, True)),
    ],
)
def test_from_bisbas(spark, scores, expected):
    assert own(spark, scores) == expected


@pytest.mark.parametrize(
    "results,expected",
    [
        ([("bdefs", 48, 60, {})], (12, 7, "reassuring", True, False, True)),
        ([("bdefs", 45, 60, {})], (12, 7, "reassuring", True, False, True)),
        ([("bdefs", 30, 60, {})], (13, 6, "balanced", True, False, False)),
        ([("bdefs", 29, 60, {})], (15, 5, "balanced", False, False, False)),
        ([("bdefs", 18, 60, {})], (17, 5, "balanced", False, True, False)),
        ([("bdefs", 19, 60, {})], (15, 5, "balanced", False, False, False)),
        ([stroop(6, 2400)], (12, 6, "reassuring", True, False, True)),
        ([stroop(9, 1100)], (17, 4, "reward", False, True, False)),
        ([stroop(9, 1200)], (17, 4, "reward", False, True, False)),
        ([stroop(9, 1201)], (15, 5, "balanced", False, False, False)),
        ([stroop(9, None)], (15, 5, "balanced", False, False, False)),
        ([stroop(9, 2200)], (12, 6, "reassuring", True, False, True)),
        ([("bisbas", 44, 80, bisbas(20, 8, 8, 8)), ("bdefs", 48, 60, {})],
         (8, 8, "reassuring", True, False, True)),
        # A reward style stays although the reaction test is weak.
        ([("bisbas", 50, 80, bisbas(10, 15, 15, 10)), stroop(6, 2400)],
         (12, 6, "reward", True, True, True)),
        # A reassuring style stays although the reaction test is sharp.
        ([("bdefs", 48, 60, {}), stroop(10, 900)], (14, 6, "reassuring", True, True, True)),
    ],
)
def test_blended(spark, results, expected):
    assert blended(spark, *results) == expected


def test_newest_wins_and_ties_go_to_the_higher_id(spark):
    data = [
        (1, 1, "bdefs", at("2024-01-01"), 20, 60, {}),
        (2, 1, "bdefs", at("2024-01-03"), 30, 60, {}),
        (3, 1, "bdefs", at("2024-01-03"), 40, 60, {}),
        (4, 1, "bdefs", at("2024-01-02"), 50, 60, {}),
    ]
    row = profiles.latest_three_types(spark.createDataFrame(data, ASSESSMENTS)).first()
    assert row.bdefs.id == 3 and row.stroop is None


def test_profile_stays_in_bounds(stand):
    found = profiles.profile_blended(stand.latest)
    out = found.filter(
        ~F.col("focus_minutes").between(8, 25) | ~F.col("break_minutes").between(4, 12)
    )
    assert out.isEmpty() and not found.isEmpty()


def test_gate_guidance_and_nudge(spark):
    data = [
        (1, "balanced", True, True), (2, "reward", True, False),
        (3, "reassuring", False, True), (4, "balanced", False, False),
    ]
    frame = spark.createDataFrame(
        data, "user_id bigint, nudge_style string, suggest_breakdown boolean, add_reassurance boolean"
    )
    text = profiles.nudge_text(F.col("nudge_style"), F.lit("Go on."), {"reward": "Well done."})
    found = frame.select(
        "user_id", profiles.act_gate().alias("g"), profiles.act_guidance_code().alias("c"), text.alias("t")
    )
    assert rows(found) == [
        (1, True, "both", "Go on."), (2, True, "breakdown", "Well done. Go on."),
        (3, True, "reassurance", "Go on."), (4, False, "neither", "Go on."),
    ]
