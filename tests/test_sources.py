"""Stores: formats, decoding, appending, message files."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions.columns import strip
from cairn.operators import messages, validate
from cairn.sources import codec, corpus, tables
from tests.helpers import at, rows


def folder():
    return tempfile.mkdtemp(prefix="cairn-test-")


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_assessments_survive_each_format(stand, spark, fmt):
    path = f"{folder()}/assessments"
    stored = stand.results.select(*schemas.ASSESSMENTS.names)
    text = fmt in ("json", "csv")
    written = codec.encode_assessments(stored) if text else stored
    writer = written.write.format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)
    read = tables.read_table(spark, path, "assessments", fmt)
    back = codec.split(codec.decode_assessments(read))[0] if text else read
    as_text = F.array_sort(F.map_entries("domain_scores")).alias("m")  # order is not kept by all
    columns = ["user_id", "id", "type", "score", "max_score", "taken_at", as_text]
    assert back.select(columns).exceptAll(stored.select(columns)).isEmpty()
    assert back.count() == stored.count()


def test_decode_rejects(spark):
    raw = spark.createDataFrame(
        [
            ("1", "1", "bdefs", "3", "60", '{"a": 3}', "2024-01-02T03:04:05.678901", None),
            ("1", "2", "mood", "-1", "0", '{"a": "x"}', "2024-01-02", None),
            ("1", "3", "stroop", "1", "2", "[1]", "2024-02-30 10:00", None),
            ("1", "4", "stroop", "1", "2", "{}", "2024-01-02 10:00", None),
            ("1", "5", None, None, None, None, None, None),
        ],
        schemas.text_form(schemas.ASSESSMENTS),
    )
    good, bad = codec.split(codec.decode_assessments(raw))
    assert [r.id for r in good.orderBy("id").collect()] == [1, 4]
    first = good.filter("id = 1").first()
    assert first.taken_at == at("2024-01-02", "03:04:05.678901") and first.domain_scores == {"a": 3}
    assert rows(bad, "id", "reasons") == [
        (2, ["type", "score", "max_score", "domain_scores"]),
        (3, ["domain_scores", "taken_at"]),
        (5, ["type", "score", "max_score", "domain_scores", "taken_at"]),
    ]


def test_decode_tasks(spark):
    raw = spark.createDataFrame(
        [
            ("1", "1", "t", None, "done", "2024-01-02T03:04:05", "2024-01-03T00:00:00", None),
            ("1", "2", "t", "1", "pending", "2024-01-02T03:04:05", "", None),
            ("1", "3", "t", "1", "later", "soon", "never", None),
            ("x1", "abc", "t", "zz", "done", "2024-01-02T03:04:05", None, None),
            (None, None, None, None, None, None, None, "{torn"),
        ],
        schemas.text_form(schemas.TASKS),
    )
    good, bad = codec.split(codec.decode_tasks(raw))
    assert rows(good, "id", "completed_at") == [(1, at("2024-01-03")), (2, None)]
    found = {r.raw_line or r.raw.get("user_id", ""): r for r in bad.collect()}
    assert found[""].reasons == ["status", "created_at", "completed_at"]
    assert found["x1"].reasons == ["user_id", "id", "parent_id"]
    assert found["x1"].raw == {"user_id": "x1", "id": "abc", "parent_id": "zz"}
    assert found["{torn"].reasons == ["line"]


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_lines_that_cannot_be_read_are_kept_whole(spark, fmt):
    path = f"{folder()}/text"
    lines = {
        "json": ['{"user_id": 1, "id": 2, "task_id": null, "duration_minutes": 5, "completed_at": "2024-01-02"}', '{"id": 3, torn'],
        "csv": ["user_id,id,task_id,duration_minutes,completed_at", "1,2,,5,2024-01-02", "9,9,9"],
    }[fmt]
    import os

    os.makedirs(path)
    with open(f"{path}/part", "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    good, bad = codec.split(codec.decode_sessions(tables.read_table(spark, path, "focus_sessions", fmt)))
    assert rows(good, "id", "duration_minutes") == [(2, 5)]
    assert rows(bad, "raw_line", "reasons") == [(lines[-1], ["line"])]


def test_append_numbers_go_on(spark, stand):
    path = f"{folder()}/focus_sessions"
    new = stand.sessions.drop("id")
    short, long = new.filter("duration_minutes < 30"), new.filter("duration_minutes >= 30")
    for number, part in ((1, short), (2, long), (2, long), (1, short)):  # retries change nothing
        tables.append(part, path, "focus_sessions", number, ["completed_at", "user_id"])
    stored = tables.read_table(spark, path, "focus_sessions")
    assert sorted(r.id for r in stored.select("id").collect()) == list(range(1, stand.sessions.count() + 1))
    one_day = tables.on_days(stored, "completed_at", "2024-01-10", "2024-01-10")
    assert "PartitionFilters: [isnotnull(day" in one_day._jdf.queryExecution().toString()
    assert one_day.count() == stand.sessions.filter(F.to_date("completed_at") == "2024-01-10").count()


def test_half_the_users_saved_again_leave_the_others(spark, stand):
    path = f"{folder()}/daily_log"
    tables.save_daily_log(stand.daily, path)
    half = stand.daily.filter("user_id % 2 = 0").withColumn("focus_minutes", F.lit(7).cast("bigint"))
    tables.save_daily_log(half, path)
    stored = tables.read_table(spark, path, "daily_log").drop("day")
    expected = half.unionByName(stand.daily.filter("user_id % 2 <> 0"))
    assert stored.count() == stand.daily.count() and stored.exceptAll(expected).isEmpty()


def test_all_texts_of_conversations_reach_the_journal(spark, stand):
    texts = stand.table("conversations").join(
        stand.table("events").select(F.col("event_id").alias("conv_id")), "conv_id", "left_semi").select("text")
    there = stand.journal.select(F.explode(F.array(*validate.JOURNAL_LIMITS)).alias("text")).filter("text is not null")
    assert texts.exceptAll(there).isEmpty() and there.exceptAll(texts).isEmpty()


def test_daily_rows_replace_their_day_only(spark, stand):
    path = f"{folder()}/daily_log"
    tables.save_daily_log(stand.daily, path)
    again = stand.daily.filter("date = '2024-01-10'").withColumn("focus_minutes", F.lit(7).cast("bigint"))
    tables.save_daily_log(again, path)
    stored = tables.read_table(spark, path, "daily_log")
    assert stored.count() == stand.daily.count()
    assert stored.filter("date = '2024-01-10'").select("focus_minutes").distinct().collect()[0][0] == 7


def test_message_files(spark):
    base = folder()
    fallback = spark.createDataFrame([("Keep going.",)], "message string")
    with open(f"{base}/m.md", "w", encoding="utf-8") as out:
        out.write("# Title\n\n- One.\n  -  Two. 　\n-\n-Three\n* Four\n- \n\t- Five\r\n- Si - Seven\n")
    found = corpus.message_corpus(spark, f"{base}/*.md", fallback)
    assert rows(found) == [("Five",), ("One.",), ("Si - Seven",), ("Two.",)]
    assert rows(corpus.message_corpus(spark, f"{base}/none*.md", fallback)) == [("Keep going.",)]
    with open(f"{base}/empty.txt", "w", encoding="utf-8") as out:
        out.write("nothing here\n")
    assert rows(corpus.message_corpus(spark, f"{base}/empty.txt", fallback)) == [("Keep going.",)]


def test_strip_is_for_every_white_space(spark):
    texts = [" a b ", "　x ", "\t\n\x1cy\x85\xa0", "", "​ z"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_dedup_keeps_the_first(spark):
    frame = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, None)], "k string, n int, v string")
    assert rows(messages.dedup_keep_first(frame, ["k"], ["n"])) == [("a", 1, "y"), ("b", 2, None)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 3}])
def test_numbers_are_dense(spark, sizes):
    frame = spark.range(100).select((F.col("id") * 7 % 100).alias("n"), F.lit("m").alias("message"))
    found = messages.number_messages(frame.repartition(5), ["n"], **sizes)
    assert rows(found, "number", "n") == [(i, i) for i in range(100)]


def test_nudges_repeat_and_cover(spark, stand):
    numbered = messages.number_messages(
        spark.createDataFrame([(f"m{i}",) for i in range(6)], "message string"), ["message"]
    )
    asked = stand.daily.select("user_id", "date")
    one, two = messages.assign_nudge(asked, numbered), messages.assign_nudge(asked, numbered)
    assert rows(one, "user_id", "date", "message") == rows(two, "user_id", "date", "message")
    assert one.count() == asked.count() and one.select("message").distinct().count() == 6
    assert messages.assign_nudge(asked, numbered.filter("number < 0")).isEmpty()


def test_validation_rules(spark):
    def broken(frame, rules):
        return [r.reasons for r in validate.check(frame, rules).orderBy("id").collect()]

    tasks = spark.createDataFrame(
        [(1, "", "pending"), (2, "x" * 500, "done"), (3, "x" * 501, "nope"), (4, None, None)], "id int, title string, status string"
    )
    assert broken(tasks, validate.task_rules()) == [
        ["title_length"], [], ["title_length", "status_unknown"], ["title_length", "status_unknown"]
    ]
    sessions = spark.createDataFrame([(1, 0), (2, 1), (3, 120), (4, 121)], "id int, duration_minutes int")
    assert broken(sessions, validate.session_rules()) == [["duration_range"], [], [], ["duration_range"]]
    daily = spark.createDataFrame([(1, 3, 45), (2, -1, 0), (3, 0, -1)], "id int, tasks_completed int, focus_minutes int")
    assert broken(daily, validate.daily_log_rules()) == [[], ["tasks_negative"], ["minutes_negative"]]
    scored = spark.createDataFrame([(1, "stroop", 0, 0), (2, "mood", -1, 5)], "id int, type string, score int, max_score int")
    assert broken(scored, validate.assessment_rules()) == [["max_not_positive"], ["type_unknown", "score_negative"]]
    trials = spark.createDataFrame([(1, "red", "red"), (2, "red", "blue")], "id int, word string, ink_colour string")
    assert broken(trials, validate.trial_rules()) == [["word_is_ink"], []]
    plans = spark.createDataFrame([(1, 0), (2, 120), (3, None)], "id int, planned_minutes int")
    assert broken(plans, validate.timer_plan_rules()) == [["plan_range"], [], ["plan_range"]]


def test_journal_is_judged_stripped(spark):
    limits = list(validate.JOURNAL_LIMITS.values())
    full = ["x" * n for n in limits]
    data = [
        (1, *[f"  {t}\n" for t in full]), (2, *[t + "x" for t in full]), (3, " \t", *full[1:]), (4, None, *full[1:])
    ]
    columns = ", ".join(f"{n} string" for n in validate.JOURNAL_LIMITS)
    frame = spark.createDataFrame(data, f"id int, {columns}")
    counts = rows(validate.check(frame, validate.journal_rules()).select("id", F.size("reasons").alias("n")))
    assert counts == [(1, 0), (2, 5), (3, 1), (4, 1)]
    assert validate.strip_journal(frame).filter("id = 1").first().values_focus == full[0]


def test_reads_by_asked_days_prune_partitions(spark, tmp_path):
    """The plan prunes by what the days turn out to be; by days and by months, nulls match nothing."""
    from cairn.sources import tables
    from tests.helpers import SESSIONS, at, day

    rows = [(1, i, None, 5, at(f"2024-0{1 + i % 3}-{1 + i % 28:02d}", "10:00:00")) for i in range(84)]
    sessions = spark.createDataFrame(rows, SESSIONS)
    path = str(tmp_path / "sessions")
    tables.append(sessions, path, "focus_sessions", 1)
    days = spark.createDataFrame([(day("2024-01-01"),), (day("2024-02-02"),), (day("2031-01-01"),), (None,)], "date date")
    stored = tables.read_table(spark, path, "focus_sessions")
    found = tables.on_asked_days(stored, "completed_at", days)
    want = sorted(r[1] for r in rows if r[4].date() in (day("2024-01-01"), day("2024-02-02")))
    assert sorted(r["id"] for r in found.collect()) == want and want
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    months = stored.drop("day").withColumn("day", F.trunc("completed_at", "month").cast("date"))
    assert sorted(r["id"] for r in tables.on_asked_days(months, "completed_at", days).collect()) == want
