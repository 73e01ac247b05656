"""Plans: what reaches the scan, what is cut before a shuffle, what never appears."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cairn.operators import activity, history, ordered, profiles, scoring, tasks, trends
from cairn.plans import stand_ins
from cairn.plans.checks import CHECKS
from cairn.plans.queries import QUERIES
from tests.conftest import DATA
from tools.compare import connect, normal

PLAIN = list(QUERIES)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_python_and_no_product(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in text


def exchanges(frame):
    return plan(frame).count("Exchange ") - plan(frame).count("BroadcastExchange ")


def test_one_shuffle_scores_and_compares(stand):
    scored = scoring.score_questionnaire(stand.answers, validated=True)
    assert exchanges(scored) == 1 and "collect_list" not in plan(scored)
    before = stand.tasks.select("user_id", "id", "status")
    assert exchanges(tasks.snapshot_diff(before, before.filter("status <> 'done'"))) == 1


@pytest.mark.parametrize("name", ["delete_results", "delete_all_results", "delete_entries", "delete_session"])
def test_deletes_shuffle_little(spark, name):
    assert exchanges(QUERIES[name](spark, DATA)) <= 8


def test_limits_are_cut_before_the_shuffle(stand):
    text = plan(history.recent_sessions(stand.sessions, 5))
    assert text.count("WindowGroupLimit") == 2
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below


def test_filters_and_columns_reach_the_scan(stand):
    text = plan(activity.daily_activity(stand.activity))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    listed = plan(stand.table("events").filter(F.col("user_id") == 3))
    assert "EqualTo(user_id,3)" in listed


def test_counters_combine_before_the_shuffle(stand):
    assert "partial_" in plan(activity.daily_activity(stand.activity))
    assert "partial_sum" in plan(scoring.score_questionnaire(stand.answers))
    assert "partial_max_by" in plan(profiles.latest_three_types(stand.results))


def test_latest_profile_has_no_join(stand):
    assert "Join" not in plan(profiles.profile_blended(stand.latest))


def test_entry_and_contract(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0
    assert contract.oracle_sql()
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees_with_its_sql(spark, name):
    import pandas as pd

    frame = QUERIES[name](spark, DATA)
    mine = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    result = connect(DATA).execute(CHECKS[name])
    other = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description], dtype=object)
    assert sorted(mine.columns) == sorted(other.columns)
    assert normal(mine) == normal(other)


def skewed(spark, rows=3000):
    """A third of all rows belongs to one user."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100)
    return spark.range(rows).select(
        hot.alias("user_id"), F.col("id"), (F.col("id") * 7919 % rows).alias("at"),
        F.when(F.col("id") % 5 > 1, F.col("id")).alias("value"),
    )


@pytest.mark.parametrize("chunk_rows", [1, 37, 1000])
def test_scans_agree_on_a_hot_key(spark, chunk_rows):
    outputs = {
        "total": ordered.total(F.lit(1)), "last": ordered.latest(F.col("value")),
        "before": ordered.previous(F.col("value")),
    }
    frame = skewed(spark)
    plain = ordered.scan(frame, ["user_id"], ["at", "id"], **outputs)
    spread = ordered.scan(frame, ["user_id"], ["at", "id"], limit=100, chunk_rows=chunk_rows, **outputs)
    columns = sorted(plain.columns)
    assert plain.select(columns).exceptAll(spread.select(columns)).isEmpty()
    assert spread.count() == plain.count()


def test_null_keys_are_one_key(spark):
    frame = skewed(spark, 300).withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))
    out = {"n": ordered.total(F.lit(1))}
    plain = ordered.scan(frame, ["user_id"], ["at", "id"], **out)
    spread = ordered.scan(frame, ["user_id"], ["at", "id"], limit=10, chunk_rows=9, **out)
    assert plain.exceptAll(spread).isEmpty() and spread.count() == 300


def test_only_large_keys_are_listed(spark):
    assert [r.user_id for r in ordered.large_keys(skewed(spark), ["user_id"], 500).collect()] == [7]


def test_hot_chunks_stay_small(spark):
    placed = ordered.chunked(skewed(spark), ["user_id"], ["at", "id"], 64)
    assert placed.groupBy("user_id", "_chunk").count().agg(F.max("count")).first()[0] <= 64
    hot = placed.filter("user_id = 7").select("_chunk").distinct().count()
    assert hot >= 1000 // 64


def test_trend_and_descendants_are_whole(stand):
    assert tasks.task_descendants(stand.tasks, stand.tasks.filter("parent_id is null")).count() == stand.tasks.count()
    fitted = trends.trend_fit(stand.results)
    assert fitted.select("id").distinct().count() == fitted.count()


def test_answer_maps_are_scored_without_a_shuffle(spark):
    assert exchanges(QUERIES["score_answer_map"](spark, DATA)) == 0


@pytest.mark.parametrize("rows", [400, 1])
def test_results_of_dealt_orders_are_shuffled_once(spark, monkeypatch, rows):
    """Dealt by user, answers and trials alike; by order if users have too many; the same results in any case."""
    want = stand_ins.StandIns(spark, DATA).latest.selectExpr("user_id", "bdefs.id b", "bisbas.score s", "stroop.id t")
    monkeypatch.setattr(stand_ins, "ORDER_ROWS", rows)
    made = stand_ins.StandIns(spark, DATA)
    if rows > 1:
        assert exchanges(made.latest) == 2
        assert made.latest.rdd.getNumPartitions() == -(-made.table("orders").count() // rows)
    else:
        assert exchanges(made.latest) > 2
    found = made.latest.selectExpr("user_id", "bdefs.id b", "bisbas.score s", "stroop.id t")
    assert sorted(found.collect()) == sorted(want.collect())


def test_results_score_questionnaires_without_a_shuffle(spark):
    """Only reaction tests are grouped; questionnaires are what their items give."""
    made = stand_ins.StandIns(spark, DATA)
    assert exchanges(made.results) == 1
    flat = ["id", "user_id", "type", "taken_at", "score", "max_score", "to_json(domain_scores) scores"]
    found = made.results.filter("type <> 'stroop'").selectExpr(*flat)
    assert sorted(found.collect()) == sorted(made.questionnaires.selectExpr(*flat).collect())
