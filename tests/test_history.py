"""Past results, trends, advice and chart data."""

import pytest
from pyspark.sql import functions as F

from cairn.catalogue import BANDS, BDEFS, BDEFS_DOMAINS, BISBAS, DOMAINS
from cairn.operators import history, scoring, trends
from tests.helpers import ASSESSMENTS, SESSIONS, at, bisbas, rows


def results(spark, *data):
    return spark.createDataFrame(
        [(i, user, kind, taken, score, whole, scores) for i, user, kind, taken, score, whole, scores in data],
        ASSESSMENTS,
    )


def bdefs(*scores):
    return dict(zip(BDEFS_DOMAINS, scores))


@pytest.fixture(scope="module")
def past(spark):
    return results(
        spark,
        (1, 1, "bdefs", at("2024-01-01"), 20, 60, bdefs(3, 3, 3, 3, 8)),
        (2, 1, "bdefs", at("2024-01-08"), 25, 60, bdefs(3, 4, 3, 7, 8)),
        (3, 1, "stroop", at("2024-01-09"), 8, 10, {"correct": 8, "trials": 10, "avg_time_ms": 1200}),
        (4, 2, "bdefs", at("2024-01-01"), 15, 60, {}),
        (5, 2, "stroop", at("2024-01-01"), 5, 10, {}),
        (6, 3, "bdefs", at("2024-01-01"), 30, 60, bdefs(6, 6, 6, 6, 6)),
        (7, 3, "bdefs", at("2024-01-01"), 31, 60, bdefs(6, 6, 6, 6, 7)),
        (8, 3, "bisbas", at("2024-01-01"), 32, 80, {**bisbas(20, 4, 4, 4), "Zest": 9}),
    )


def test_recent_and_latest(past):
    assert rows(history.recent_assessments(past, 2), "user_id", "id", "rank") == [
        (1, 2, 2), (1, 3, 1), (2, 4, 2), (2, 5, 1), (3, 7, 2), (3, 8, 1)
    ]
    assert rows(history.recent_assessments(past, 1, "bdefs"), "id") == [(2,), (4,), (7,)]
    assert rows(history.latest_per_type(past), "id") == [(2,), (3,), (4,), (5,), (7,), (8,)]
    assert rows(history.count_results(past)) == [(1, 3), (2, 2), (3, 3)]
    pairs = history.latest_vs_previous(past)
    assert rows(pairs.filter("type = 'bdefs'"), "latest.id", "previous.id") == [(2, 1), (4, None), (7, 6)]


def test_trend(past):
    fitted = trends.trend_fit(past)
    found = {r.id: r for r in fitted.collect()}
    assert set(found) == {1, 2, 6, 7}  # one point gives no line
    assert found[1].slope == pytest.approx(5 / 7)
    assert found[1].fitted == pytest.approx(20) and found[2].fitted == pytest.approx(25)
    assert found[6].slope is None and found[6].fitted is None  # one instant gives no line


def test_hot_user_is_split_in_the_join_of_lines(spark):
    """A third of all results belong to one user; the join must not keep them together."""
    data = spark.range(600_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("user_id"),
        F.lit("bdefs").alias("type"),
        (F.lit(at("2024-01-01")).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 900).cast("int"))).alias("taken_at"),
        (F.col("id") % 46 + 15).cast("int").alias("score"),
    )
    small = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    old = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        fitted = trends.trend_fit(data.repartition(16))
        fitted.collect()
        assert "skew=true" in fitted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_reserve(past):
    pairs = history.latest_vs_previous(past)
    found = {(r.user_id, r.place): r for r in history.reserve_delta(pairs).collect()}
    assert (found[(1, 0)].now, found[(1, 0)].direction) == (75.0, "steady")
    assert (found[(1, 1)].direction, found[(1, 1)].shown) == ("down", -8.0)
    assert (found[(2, 0)].direction, found[(2, 0)].shown) == ("only", 100.0)
    assert found[(3, 4)].shown == -8.0
    overall = {r.user_id: r for r in history.reserve_overall(pairs).collect()}
    assert overall[1].direction == "down" and overall[2].direction is None
    assert overall[2].reserve == 75.0


def test_rounding_is_half_even(spark):
    row = spark.range(1).select(F.bround(F.lit(12.5), 0).alias("a"), F.bround(F.lit(13.5), 0).alias("b")).first()
    assert tuple(row) == (12.0, 14.0)


def test_vectors(past):
    row = past.filter("id = 8").select(
        history.radar_vector(F.col("domain_scores")).alias("r"), history.bisbas_bars(F.col("domain_scores")).alias("b")
    ).first()
    assert row.r == [0.0] * 5 and row.b == [15, 0, 0, 0]
    over = past.filter("id = 1").withColumn("domain_scores", F.create_map(F.lit("Self-Restraint"), F.lit(15)))
    assert over.select(history.reserve_pct(F.col("domain_scores")).alias("p")).first().p == [100.0, 100.0, 0.0, 100.0, 100.0]


def test_entries(past):
    entries = history.history_entries(past)
    found = {r.id: [tuple(x) for x in r.lines] for r in entries.collect()}
    assert found[2][0] == ("total", None, 25, 60, None)
    assert found[2][-1] == ("reading", None, None, None, "mild")
    assert ("domain", "Self-Motivation", 7, None, "moderate") in found[2]
    assert found[3] == [
        ("total", None, 8, 10, None), ("time", None, 1200, None, None),
        ("reading", None, None, None, "good"), ("reading", None, None, None, "average"),
    ]
    assert found[5][1] == ("time", None, 0, None, None)
    assert found[8][0] == ("total", None, 12, 60, None)
    assert ("domain", "Behavioral Inhibition (BIS)", 15, 15, "high") in found[8]
    assert ("domain", "BAS Drive", 0, 15, "low") in found[8]
    assert ("domain", "Zest", 9, 1, None) in found[8]


def test_a_missing_score_map_keeps_total_and_readings(past):
    bare = past.withColumn("domain_scores", F.lit(None).cast("map<string,int>"))
    for r in history.history_entries(bare).collect():
        parts = [x.part for x in r.lines]
        assert parts[0] == "total" and "reading" in parts and "domain" not in parts


def test_words_are_the_callers(spark, past):
    labels = spark.createDataFrame(
        [("total", None, "points"), ("reading", "mild", "a little"), ("reading", None, "other")],
        "part string, code string, label string",
    )
    found = history.worded(history.history_entries(past), labels)
    rows_ = {(r.part, r.code): r.label for r in found.filter("id = 2").collect()}
    assert rows_[("total", None)] == "points" and rows_[("reading", "mild")] == "a little"
    assert {v for (part, _), v in rows_.items() if part == "domain"} == {None}


def advice(spark):
    data = [(k, d, b, f"{d} {b}") for k, names in DOMAINS.items() for d in names for b in BANDS[k]]
    data.append(("bdefs", "Zest", "mild", "unused"))
    return spark.createDataFrame(data, "type string, domain string, band string, text string")


def test_advice(spark, past):
    found = history.advice_lookup(scoring.explode_domains(past), advice(spark))
    texts = {(r.id, r.domain): r.text for r in found.collect()}
    assert texts[(1, "Emotion Regulation")] == "Emotion Regulation moderate"
    assert texts[(8, "Zest")] == "" and texts[(8, "BAS Drive")] == "BAS Drive low"
    assert len(texts) == 5 * 4 + 5


def test_advice_by_range_agrees(spark, stand):
    ends = {BDEFS: [-1.0, 25.0, 50.0, 75.0, 1e9], BISBAS: [-1.0, 50.0, 75.0, 1e9]}
    cuts = spark.createDataFrame(
        [(k, d, lo, hi, b) for k, names in DOMAINS.items() for d in names
         for lo, hi, b in zip(ends[k], ends[k][1:], BANDS[k])],
        "type string, domain string, lo double, hi double, band string",
    )
    domains = scoring.explode_domains(stand.questionnaires)
    by_range = history.advice_lookup_range(domains, cuts).select("id", "domain", "band")
    by_case = history.advice_lookup(domains, advice(spark)).select("id", "domain", "band")
    assert by_range.exceptAll(by_case).isEmpty() and by_case.exceptAll(by_range).isEmpty()


@pytest.mark.parametrize("sizes", [{}, {"limit": 1, "chunk_rows": 2}])
def test_result_in_force(spark, sizes):
    taken = results(
        spark,
        (1, 1, "bisbas", at("2024-01-02"), 40, 80, bisbas(10, 10, 10, 10)),
        (2, 1, "bisbas", at("2024-01-04"), 50, 80, bisbas(10, 10, 10, 20)),
        (3, 1, "bdefs", at("2024-01-03"), 20, 60, {}),
    )
    ended = [at("2024-01-01"), at("2024-01-02"), at("2024-01-03"), at("2024-01-04"), at("2024-01-09")]
    sessions = spark.createDataFrame([(1, i, None, 10, t) for i, t in enumerate(ended)] + [(2, 9, None, 1, ended[0])], SESSIONS)
    found = history.assessment_asof_session(sessions, taken, **sizes)
    assert rows(found, "user_id", "id", "result_id") == [(1, 0, None), (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 9, None)]


def test_distribution_counts_each_user_once(stand):
    users = stand.questionnaires.filter("type = 'bdefs'").select("user_id").distinct().count()
    found = history.band_distribution(stand.results).filter("domain = 'Self-Restraint'")
    assert found.agg(F.sum("users")).first()[0] == users
