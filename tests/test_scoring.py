"""Scoring and bands against hand-traced values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.catalogue import BDEFS, BDEFS_DOMAINS, BISBAS, BISBAS_DOMAINS, DRIVE, total_max
from cairn.functions import bands
from cairn.functions.sql import register_functions
from cairn.operators import scoring, validate
from tests.helpers import at, bisbas, rows

ANSWERS = (
    "assessment_id bigint, user_id bigint, taken_at timestamp_ntz, type string, domain string, "
    "item_no int, response int"
)
TRIALS = (
    "assessment_id bigint, user_id bigint, taken_at timestamp_ntz, trial_no int, word string, "
    "ink_colour string, answer string, elapsed_ms int"
)


def keys(scored):
    """Domain names in stored order; Python dicts of a row lose it."""
    return scored.select(F.map_keys("domain_scores").alias("k")).first().k


def answers(spark, kind, value, extra=()):
    names, items = (BDEFS_DOMAINS, 3) if kind == BDEFS else (BISBAS_DOMAINS, 5)
    data = [
        (1, 7, at("2024-01-01"), kind, name, i, value) for name in names for i in range(items)
    ]
    data += [(1, 7, at("2024-01-01"), kind, name, 0, v) for name, v in extra]
    return spark.createDataFrame(data, ANSWERS)


@pytest.mark.parametrize("value,total", [(1, 15), (4, 60), (2, 30)])
def test_bdefs_totals(spark, value, total):
    scored = scoring.score_questionnaire(answers(spark, BDEFS, value))
    row = scored.first()
    assert (row.score, row.max_score) == (total, 60)
    assert row.domain_scores == {d: 3 * value for d in BDEFS_DOMAINS}
    assert keys(scored) == list(BDEFS_DOMAINS)


def test_bisbas_total(spark):
    scored = scoring.score_questionnaire(answers(spark, BISBAS, 3))
    row = scored.first()
    assert (row.score, row.max_score) == (60, 80)
    assert keys(scored) == list(BISBAS_DOMAINS)


def test_unknown_domain_counts_but_scale_stays(spark):
    scored = scoring.score_questionnaire(answers(spark, BDEFS, 1, [("Zest", 4)]))
    row = scored.first()
    assert (row.score, row.max_score) == (19, 60)
    assert keys(scored)[-1] == "Zest"
    checked = validate.rejected(answers(spark, BDEFS, 1, [("Zest", 9)]), validate.answer_rules())
    assert checked.first().reasons == ["response_range", "domain_unknown"]


def test_wide_answers_score_alike(spark):
    wide = spark.createDataFrame(
        [(1, 7, BDEFS, at("2024-01-01"), {d: [2, 2, 2] for d in BDEFS_DOMAINS})],
        "id bigint, user_id bigint, type string, taken_at timestamp_ntz, answers map<string,array<int>>",
    )
    row = scoring.score_answer_map(wide).first()
    assert (row.score, row.max_score) == (30, 60)
    assert row.domain_scores == {d: 6 for d in BDEFS_DOMAINS}


def test_stroop_score(spark):
    data = [
        (1, 7, at("2024-01-01"), i, "red", "blue", " BLUE\t" if i < 8 else ("" if i == 8 else None), 1200)
        for i in range(10)
    ]
    trials = spark.createDataFrame(data, TRIALS)
    row = scoring.score_stroop(trials).first()
    assert (row.score, row.max_score, row.domain_scores["avg_time_ms"]) == (8, 10, 1200)
    accuracy = scoring.stroop_accuracy(trials).first()
    assert (accuracy.accuracy_pct, accuracy.avg_time_s) == (80.0, 1.2)


def test_stroop_average_is_truncated(spark):
    data = [(1, 7, at("2024-01-01"), i, "red", "blue", "blue", ms) for i, ms in enumerate((1, 1, 3))]
    row = scoring.score_stroop(spark.createDataFrame(data, TRIALS)).first()
    assert row.domain_scores["avg_time_ms"] == 1


def test_mean_counts_results_without_the_domain(spark):
    data = [(1, 1, {"a": 4, "b": 2}), (2, 1, {"a": 8}), (3, 2, {})]
    results = spark.createDataFrame(data, "id bigint, user_id bigint, domain_scores map<string,int>")
    assert rows(scoring.mean_domain_scores(results)) == [(1, "a", 6.0), (1, "b", 1.0)]


def test_limits_from_items(spark):
    items = [(BDEFS, d) for d in BDEFS_DOMAINS for _ in range(3)]
    items += [(BISBAS, d) for d in BISBAS_DOMAINS for _ in range(5)]
    limits = scoring.questionnaire_limits(spark.createDataFrame(items, "type string, domain string"))
    found = {(r.type, r.domain): (r.floor_score, r.max_score, r.score_range) for r in limits.collect()}
    assert found[(BDEFS, None)] == (15, 60, 45)
    assert found[(BISBAS, None)] == (20, 80, 60)
    assert found[(BISBAS, DRIVE)] == (5, 20, 15)
    assert total_max(BDEFS) == 60


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    "score,band",
    [(15, "minimal"), (16, "mild"), (20, "mild"), (30, "mild"), (31, "moderate"), (40, "moderate"),
     (45, "moderate"), (46, "significant"), (55, "significant")],
)
def test_bdefs_bands(spark, score, band):
    assert one(spark, b=bands.bdefs_band(F.lit(score), F.lit(60))).b == band


@pytest.mark.parametrize("score,band", [(3, "minimal"), (6, "mild"), (9, "moderate"), (10, "high")])
def test_domain_bands(spark, score, band):
    row = one(
        spark,
        b=bands.domain_band(F.lit("Self-Restraint"), F.lit(score), F.lit(12)),
        none=bands.domain_band(F.lit("Zest"), F.lit(score), F.lit(12)),
        flat=bands.domain_band(F.lit("Self-Restraint"), F.lit(score), F.lit(0)),
    )
    assert (row.b, row.none, row.flat) == (band, None, "minimal")


def test_bisbas_normalisation(spark):
    row = one(
        spark,
        low=bands.bisbas_domain_score(F.lit(DRIVE), F.lit(5)),
        high=bands.bisbas_domain_score(F.lit(DRIVE), F.lit(20)),
        under=bands.bisbas_domain_score(F.lit(DRIVE), F.lit(2)),
        span=bands.bisbas_domain_range(F.lit(DRIVE)),
        other=bands.bisbas_domain_score(F.lit("Zest"), F.lit(7)),
        nothing=bands.bisbas_domain_range(F.lit("Zest")),
        total=bands.bisbas_total(F.lit(26)),
    )
    assert tuple(row) == (0, 15, 0, 15, 7, 0, 6)


def test_bisbas_codes(spark):
    scores = spark.createDataFrame([(26, bisbas(5, 11, 5, 5))], "score int, m map<string,int>")
    codes = scores.select(bands.bisbas_profile_codes(F.col("score"), F.col("m")).alias("c")).first().c
    assert codes == ["bis_low_to_moderate", "drive_low", "reward_weak", "fun_weak", "overall_low"]


@pytest.mark.parametrize(
    "raw,expected",
    [
        # 11 of 15 is below 75, 8 of 15 above 50: reward and fun say nothing.
        (16, ["bis_moderate", "drive_moderate", "overall_high"]),
        (17, ["bis_high", "drive_strong", "reward_strong", "fun_strong", "overall_high"]),
        (12, ["bis_moderate", "drive_low", "reward_weak", "fun_weak", "overall_moderate"]),
        (13, ["bis_moderate", "drive_moderate", "overall_moderate"]),
        (11, ["bis_low_to_moderate", "drive_low", "reward_weak", "fun_weak", "overall_moderate"]),
    ],
)
def test_bisbas_code_boundaries(spark, raw, expected):
    scores = spark.createDataFrame([(4 * raw, bisbas(raw, raw, raw, raw))], "score int, m map<string,int>")
    codes = scores.select(bands.bisbas_profile_codes(F.col("score"), F.col("m")).alias("c")).first().c
    assert codes == expected


def test_bisbas_tips(spark):
    def tips(*raw):
        frame = spark.createDataFrame([(bisbas(*raw),)], "m map<string,int>")
        return frame.select(bands.bisbas_tip_codes(F.col("m")).alias("c")).first().c

    assert tips(20, 8, 20, 20) == ["bis_high", "drive_low", "reward_high", "fun_high"]
    assert tips(11, 14, 5, 5) == ["bis_low", "reward_other", "fun_other"]
    assert tips(14, 20, 5, 5) == ["bis_middle", "drive_high", "reward_other", "fun_other"]


@pytest.mark.parametrize(
    "correct,ms,codes",
    [(9, 800, ("excellent", "fast")), (8, 1500, ("good", "average")), (6, 2500, ("moderate", "slow")),
     (3, 1000, ("low", "fast")), (7, 2000, ("good", "average")), (5, 2001, ("moderate", "slow"))],
)
def test_stroop_codes(spark, correct, ms, codes):
    row = one(
        spark,
        a=bands.stroop_accuracy_code(F.lit(correct), F.lit(10)),
        s=bands.stroop_speed_code(F.lit(ms)),
        z=bands.stroop_accuracy_code(F.lit(0), F.lit(0)),
    )
    assert tuple(row) == (*codes, "low")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 200), min_size=1, max_size=40))
def test_every_score_has_one_band(spark, scores):
    frame = spark.createDataFrame([(s,) for s in scores], "s int")
    names = {"minimal", "mild", "moderate", "significant"}
    found = frame.select("s", bands.bdefs_band(F.col("s"), F.lit(60)).alias("b")).collect()
    order = ["minimal", "mild", "moderate", "significant"]
    assert {r.b for r in found} <= names
    ranked = [order.index(r.b) for r in sorted(found, key=lambda r: r.s)]
    assert ranked == sorted(ranked)


def test_sql_functions_agree(spark):
    names = register_functions(spark)
    assert "cairn_bdefs_band" in names
    row = spark.sql(
        "SELECT cairn_bdefs_band(20, 60) a, cairn_domain_band(10, 12) b, cairn_percent(1, 0) c, "
        "cairn_stroop_accuracy(9, 10) d, cairn_stroop_speed(1500) e, cairn_clamp(30, 8, 25) f"
    ).first()
    assert tuple(row) == ("mild", "high", 0.0, "excellent", "average", 25)
