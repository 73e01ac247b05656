"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.catalogue import BANDS, BDEFS, BISBAS, DOMAINS, STROOP, domain_max
from cairn.functions import bands
from cairn.functions.columns import micros, score_of
from cairn.operators import (
    activity, history, intervals, messages, profiles, scoring, sessions, state, tasks, trends, validate,
)
from cairn.plans.stand_ins import (
    AS_OF, StandIns, valid_activity, with_activity_columns, with_timer_columns,
)
from cairn.session import durable, new_folder
from cairn.sources import codec, corpus, tables
from cairn.streaming import activity as stream_activity
from cairn.streaming import chains as stream_chain_folds
from cairn.streaming import profiles as stream_profiles
from cairn.streaming import sink
from cairn.streaming import timers as stream_timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Example prefixes and message wordings are the caller's own.
PREFIXES = {"reassuring": "Gently now.", "reward": "Well earned."}


def query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query under its function name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(StandIns(spark, folder))

    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def joined(codes: str) -> Column:
    """An array of codes as one text."""
    return F.array_join(codes, "|").alias(codes)


def places(scores: Column, name: str) -> Column:
    """An array of numbers as rows of place and value."""
    return F.posexplode(scores).alias("place", name)


# --- scans, sources, sinks -----------------------------------------------------


@query
def scan_tables(d: StandIns) -> DataFrame:
    """Store all five tables and scan them back with their schemas."""
    folder = new_folder(d.spark, "tables")
    stored = {
        "tasks": d.tasks,
        "focus_sessions": d.sessions,
        "daily_log": d.daily,
        "assessments": d.results,
        "act_journal_entries": validate.valid(d.journal, validate.journal_rules()),
    }
    for name, rows in stored.items():
        rows.write.parquet(f"{folder}/{name}")
    summaries = [
        table.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("stored_rows"),
            F.count_distinct("user_id").alias("users"),
            F.min("user_id").alias("lowest_user"),
            F.max("user_id").alias("highest_user"),
        )
        for name, table in tables.scan_tables(d.spark, folder).items()
    ]
    whole = summaries[0]
    for one in summaries[1:]:
        whole = whole.unionByName(one)
    return whole


def _text_store(rows: DataFrame, spark: SparkSession, table: str) -> DataFrame:
    """Rows as lines of JSON, some of them torn off, read back as text."""
    folder = new_folder(spark, "text")
    torn = F.format_string('{"id": %d, torn', F.col("id"))
    whole = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(F.col("id") % 19 == 6, torn).otherwise(whole)).write.text(folder)
    return tables.read_table(spark, folder, table, "json")


@query
def decode_tasks(d: StandIns) -> DataFrame:
    """Tasks from a text store in which some states and times are damaged."""
    key = F.col("id")
    raw = codec.encode_times(d.tasks).withColumns(
        {
            "status": F.when(key % 7 == 3, "someday").otherwise(F.col("status")),
            "parent_id": F.when(key % 17 == 4, "zz").otherwise(F.col("parent_id").cast("string")),
            "created_at": F.when(key % 11 == 5, "last week").otherwise(F.col("created_at")),
            "completed_at": F.when(key % 13 == 1, "").otherwise(F.col("completed_at")),
        }
    )
    decoded = codec.decode_tasks(_text_store(raw, d.spark, "tasks"))
    return decoded.select(
        "user_id", "id", "title", "parent_id", "status", "created_at", "completed_at",
        joined("reasons"), F.col("raw")["parent_id"].alias("raw_parent"), "raw_line",
    )


@query
def decode_sessions(d: StandIns) -> DataFrame:
    """Focus records from a text store, durations of 0 included."""
    raw = d.activity.filter(F.col("kind") == "focus").select(
        "user_id", F.col("event_id").alias("id"), F.lit(None).cast("bigint").alias("task_id"),
        F.when(F.col("event_id") % 17 == 4, "soon").otherwise(F.col("duration_minutes").cast("string"))
        .alias("duration_minutes"),
        F.when(F.col("event_id") % 13 == 1, "").otherwise(codec.iso_text(F.col("ts"))).alias("completed_at"),
    )
    decoded = codec.decode_sessions(_text_store(raw, d.spark, "focus_sessions"))
    return decoded.select("user_id", "id", "duration_minutes", "completed_at", joined("reasons"), "raw_line")


@query
def decode_assessments(d: StandIns) -> DataFrame:
    """Results from a text store in which some score maps are damaged."""
    coded = codec.encode_assessments(d.results)
    key = F.col("id")
    raw = coded.withColumns(
        {
            "domain_scores": F.when(key % 9 == 2, "{broken").otherwise(F.col("domain_scores")),
            "score": F.when(key % 17 == 4, "many").otherwise(F.col("score").cast("string")),
        }
    )
    decoded = codec.decode_assessments(_text_store(raw, d.spark, "assessments"))
    return decoded.select(
        "user_id", "id", "type", "score", "max_score", "taken_at",
        F.size(F.coalesce("domain_scores", F.create_map().cast("map<string,int>"))).alias("domains"),
        F.aggregate(F.map_values("domain_scores"), F.lit(0), lambda a, x: a + x).alias("domain_sum"),
        joined("reasons"), "raw_line",
    )


@query
def decode_journal(d: StandIns) -> DataFrame:
    """Journal entries from a text store."""
    raw = codec.encode_times(d.journal).withColumn(
        "created_at", F.when(F.col("id") % 5 == 2, "2024-13-40").otherwise(F.col("created_at"))
    )
    decoded = codec.decode_journal(_text_store(raw, d.spark, "act_journal_entries"))
    return decoded.select("user_id", "id", "values_focus", "created_at", joined("reasons"), "raw_line")


@query
def encode_assessments(d: StandIns) -> DataFrame:
    """Results with their score maps as JSON text."""
    return codec.encode_assessments(d.results).select(
        "user_id", "id", "type", "score", "max_score", "domain_scores", "taken_at"
    )


@query
def message_corpus(d: StandIns) -> DataFrame:
    """Messages out of Markdown files written from all documents; there is a fallback, and no need of it."""
    folder = new_folder(d.spark, "markdown")
    d.markdown.select("text").write.option("lineSep", "\n").text(folder)
    return corpus.message_corpus(d.spark, folder, _fallback(d)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def _fallback(d: StandIns) -> DataFrame:
    """The languages of documents as fallback messages."""
    return d.table("documents").select(F.concat(F.lit("fallback "), F.col("lang")).alias("message"))


@query
def message_corpus_fallback(d: StandIns) -> DataFrame:
    """The same files without a bullet in them: the fallback counts."""
    folder = new_folder(d.spark, "markdown")
    d.table("documents").select(F.regexp_replace("text", "(?m)^[^A-Za-z]*-", "").alias("text")).write.text(folder)
    return corpus.message_corpus(d.spark, folder, _fallback(d)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query
def dedup_keep_first(d: StandIns) -> DataFrame:
    """The first document of each exact text; only digests of the texts are shuffled."""
    rows = d.table("documents").select(
        F.sha2("text", 256).alias("text_hash"), "doc_id", "source", "n_chars"
    )
    return messages.dedup_keep_first(rows, ["text_hash"], ["doc_id"])


@query
def sink_append(d: StandIns) -> DataFrame:
    """Focus records appended in two batches that get their ids on the way."""
    path = new_folder(d.spark, "appended")
    new = d.sessions.drop("id")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    early, late = new.filter(F.col("completed_at") < half), new.filter(F.col("completed_at") >= half)
    for number, batch in ((1, early), (2, late), (2, late)):  # the second is tried twice
        tables.append(batch, path, "focus_sessions", number, ["completed_at", "user_id"])
    return tables.read_table(d.spark, path, "focus_sessions").drop(tables.BATCH, tables.DAY)


def _appended(d: StandIns, table: str, rows: DataFrame) -> DataFrame:
    """Rows in three batches by user, the middle one appended twice."""
    path = new_folder(d.spark, "appended")
    for number in (0, 1, 1, 2):
        tables.append(rows.filter(F.col("user_id") % 3 == number), path, table, number)
    return tables.read_table(d.spark, path, table).drop(tables.BATCH, tables.DAY)


@query
def sink_append_tasks(d: StandIns) -> DataFrame:
    """Tasks appended with the ids they have."""
    return _appended(d, "tasks", d.tasks)


@query
def sink_append_assessments(d: StandIns) -> DataFrame:
    """Results appended; the score map as its number of domains."""
    stored = _appended(d, "assessments", d.results)
    return stored.select("user_id", "id", "type", "score", "max_score", "taken_at", F.size("domain_scores").alias("domains"))


@query
def sink_append_journal(d: StandIns) -> DataFrame:
    """Whole journal entries appended."""
    good = validate.valid(d.journal, validate.journal_rules())
    return _appended(d, "act_journal_entries", good).select("user_id", "id", "values_focus", "committed_action", "created_at")


@query
def sink_daily_log(d: StandIns) -> DataFrame:
    """Counters stored for all, then those of even users saved anew with an hour more."""
    path = new_folder(d.spark, "daily")
    tables.save_daily_log(d.daily, path)
    more = F.col("focus_minutes") + 60
    tables.save_daily_log(d.daily.filter(F.col("user_id") % 2 == 0).withColumn("focus_minutes", more), path)
    return tables.read_table(d.spark, path, "daily_log").drop(tables.DAY)


# --- validation ----------------------------------------------------------------


@query
def validate_tasks(d: StandIns) -> DataFrame:
    """Documents taken for task titles: many are too long, one language is no status."""
    lang = F.col("lang")
    rows = d.table("documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.when(lang == "en", "pending").when(lang == "fr", "active").when(lang == "de", "done")
        .otherwise(lang).alias("status"),
    )
    return validate.check(rows, validate.task_rules()).select("id", "status", joined("reasons"))


@query
def validate_sessions(d: StandIns) -> DataFrame:
    """Focus durations."""
    rows = d.activity.filter(F.col("kind") == "focus")
    return validate.check(rows, validate.session_rules()).select(
        "event_id", "duration_minutes", joined("reasons")
    )


@query
def validate_daily_log(d: StandIns) -> DataFrame:
    """Counters less a daily aim, so that some are negative."""
    less = d.daily.withColumns(
        {
            "tasks_completed": F.col("tasks_completed") - 1,
            "focus_minutes": F.col("focus_minutes") - 30,
        }
    )
    return validate.check(less, validate.daily_log_rules()).select(
        "user_id", "date", "tasks_completed", "focus_minutes", joined("reasons")
    )


@query
def validate_assessments(d: StandIns) -> DataFrame:
    """Results with scores and scales moved down, some types unknown."""
    moved = d.results.withColumns(
        {
            "score": F.col("score") - 20,
            "max_score": F.col("max_score") - 10,
            "type": F.when(F.col("user_id") % 5 == 0, F.upper("type")).otherwise(F.col("type")),
        }
    )
    return validate.check(moved, validate.assessment_rules()).select("id", "type", joined("reasons"))


@query
def validate_journal(d: StandIns) -> DataFrame:
    """Journal entries."""
    return validate.check(d.journal, validate.journal_rules()).select("id", joined("reasons"))


@query
def validate_answers(d: StandIns) -> DataFrame:
    """Answers spread beyond the scale, counted by reason."""
    wide = d.answers.withColumn("response", F.col("response") * 2 - 2)
    checked = validate.check(wide, validate.answer_rules()).select(
        "type", "domain", "response", joined("reasons")
    )
    return checked.groupBy("type", "domain", "response", "reasons").agg(
        F.count(F.lit(1)).alias("answers")
    )


@query
def validate_trials(d: StandIns) -> DataFrame:
    """Trials, counted by reason."""
    checked = validate.check(d.trials, validate.trial_rules()).select(
        "word", "ink_colour", joined("reasons")
    )
    return checked.groupBy("word", "ink_colour", "reasons").agg(F.count(F.lit(1)).alias("trials"))


@query
def validate_timer_plan(d: StandIns) -> DataFrame:
    """All events taken for timer plans."""
    rows = d.table("events").select("event_id", F.floor("value").cast("int").alias("planned_minutes"))
    return validate.check(rows, validate.timer_plan_rules()).select(
        "event_id", "planned_minutes", joined("reasons")
    )


# --- projections, filters, lookups -----------------------------------------------


@query
def task_by_id(d: StandIns) -> DataFrame:
    """Every task a focus session names, null where it does not exist."""
    wanted = d.sessions.filter(F.col("task_id").isNotNull()).select(
        "user_id", F.col("task_id").alias("id")
    )
    return tasks.find_tasks(d.tasks, wanted)


@query
def list_tasks(d: StandIns) -> DataFrame:
    """Pending tasks, oldest first."""
    return tasks.list_tasks(d.tasks, status="pending").withColumn("is_subtask", tasks.is_subtask())


@query
def subtasks(d: StandIns) -> DataFrame:
    """Children of all active tasks."""
    return tasks.subtasks_of(d.tasks, d.tasks.filter(F.col("status") == "active"))


@query
def open_count(d: StandIns) -> DataFrame:
    """Open tasks per user."""
    return tasks.open_count(d.tasks)


@query
def daily_log_lookup(d: StandIns) -> DataFrame:
    """Three days of every user; the last has no activity at all."""
    days = [dt.date(2024, 1, 15), AS_OF, dt.date(2024, 2, 3)]
    return activity.daily_log_on(d.daily, d.activity, days)


@query
def list_daily_logs(d: StandIns) -> DataFrame:
    """All counters."""
    return activity.list_daily_logs(d.daily)


@query
def count_results(d: StandIns) -> DataFrame:
    """Results per user."""
    return history.count_results(d.results)


# --- joins -----------------------------------------------------------------------


@query
def tasks_by_parent(d: StandIns) -> DataFrame:
    """Open sub-tasks beside their parents."""
    return tasks.tasks_by_parent(d.tasks)


@query
def sessions_with_task(d: StandIns) -> DataFrame:
    """Focus records beside their tasks."""
    return tasks.sessions_with_task(d.sessions, d.tasks)


@query
def dangling_parents(d: StandIns) -> DataFrame:
    """Sub-tasks left over once done tasks are taken out."""
    return tasks.dangling_parents(d.tasks.filter(F.col("status") != "done"))


@query
def task_descendants(d: StandIns) -> DataFrame:
    """Everything at or below a top-level or a done task."""
    roots = d.tasks.filter(F.col("parent_id").isNull() | (F.col("status") == "done"))
    return tasks.task_descendants(d.tasks, roots)


@query
def active_days_semi(d: StandIns) -> DataFrame:
    """Active days that follow an active day."""
    return activity.days_in_streaks(d.daily, AS_OF)


def _advice(d: StandIns) -> DataFrame:
    rows = [
        (kind, domain, band, f"advice on {domain}: {band}")
        for kind, names in DOMAINS.items()
        for domain in names
        for band in BANDS[kind]
    ]
    return d.spark.createDataFrame(rows, "type string, domain string, band string, text string")


@query
def advice_lookup(d: StandIns) -> DataFrame:
    """Advice per domain score."""
    found = history.advice_lookup(scoring.explode_domains(d.questionnaires), _advice(d))
    return found.select("id", "type", "domain", "domain_score", "band", "text")


def _cuts(d: StandIns) -> DataFrame:
    ends = {BDEFS: [-1.0, 25.0, 50.0, 75.0, 1e9], BISBAS: [-1.0, 50.0, 75.0, 1e9]}
    rows = [
        (kind, domain, lo, hi, band)
        for kind, names in DOMAINS.items()
        for domain in names
        for lo, hi, band in zip(ends[kind], ends[kind][1:], BANDS[kind])
    ]
    return d.spark.createDataFrame(
        rows, "type string, domain string, lo double, hi double, band string"
    )


@query
def advice_lookup_range(d: StandIns) -> DataFrame:
    """Bands by range join."""
    found = history.advice_lookup_range(scoring.explode_domains(d.questionnaires), _cuts(d))
    return found.select("id", "type", "domain", "domain_score", F.round("pct", 6).alias("pct"), "band")


@query
def records_in_windows(d: StandIns) -> DataFrame:
    """Focus records beside every timer start, of whoever, that came as many seconds before as it planned minutes."""
    begin = micros(F.col("ts"))
    starts = d.timer_events.filter(F.col("kind") == "start").select(
        F.col("event_id").alias("start_event_id"),
        begin.alias("lo"), (begin + F.col("planned_minutes").cast("bigint") * 1_000_000).alias("hi"),
    )
    records = d.sessions.withColumn("at", micros(F.col("completed_at")))
    found = intervals.interval_join(records, starts, "at", "lo", "hi")
    return found.select("user_id", "id", "completed_at", F.col("range.start_event_id").alias("start_event_id"))


@query
def latest_three_types(d: StandIns) -> DataFrame:
    """Newest result of each type in one row."""
    picks = [
        F.col(f"{kind}.{field}").alias(f"{kind}_{field}")
        for kind in (BDEFS, STROOP, BISBAS)
        for field in ("id", "score", "taken_at")
    ]
    return d.latest.select("user_id", *picks)


@query
def assessment_asof_session(d: StandIns) -> DataFrame:
    """Focus records moved back into the years of the results, with the result in force."""
    key = F.col("id")
    back = F.make_dt_interval((F.lit(8400) + key % 2300).cast("int"))
    moved = d.sessions.withColumn("completed_at", F.col("completed_at") - back)
    stored = durable(d.questionnaires.filter(F.col("type") == BISBAS))
    return history.assessment_asof_session(moved, stored).drop("domain_scores")


# --- aggregations ------------------------------------------------------------------


@query
def daily_activity(d: StandIns) -> DataFrame:
    """Counters per user and day."""
    return d.daily


@query
def sessions_on_days(d: StandIns) -> DataFrame:
    """Stored focus records of the days with most completions, read by their partitions alone."""
    path = new_folder(d.spark, "sessions-by-day")
    tables.append(d.sessions, path, "focus_sessions", 1)
    days = d.daily.filter((F.col("tasks_completed") >= 3) & (F.dayofmonth("date") % 7 == 1)).select("date")
    stored = tables.read_table(d.spark, path, "focus_sessions")
    return tables.on_asked_days(stored, "completed_at", days).select("user_id", "id", "task_id", "duration_minutes", "completed_at")


@query
def week_totals(d: StandIns) -> DataFrame:
    """This week's sums."""
    return activity.week_totals(d.daily, AS_OF)


@query
def streak_days(d: StandIns) -> DataFrame:
    """Current streaks."""
    return activity.streak_days(d.daily, AS_OF)


@query
def status_summary(d: StandIns) -> DataFrame:
    """The dashboard row of each user."""
    return activity.status_summary(d.daily, d.tasks, AS_OF)


@query
def status_lists(d: StandIns) -> DataFrame:
    """The open tasks of the dashboard with their place."""
    return tasks.open_task_list(d.tasks)


@query
def status_view(d: StandIns) -> DataFrame:
    """The dashboard rows with their lists of open tasks inside, five of each kind."""
    whole = activity.status_view(d.daily, d.tasks, AS_OF, n=5)
    lists = {k: F.to_json(F.transform(k, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title")))) for k in ("pending", "active")}
    return whole.withColumns(lists)


@query
def progress_pct(d: StandIns) -> DataFrame:
    """Progress today."""
    summary = activity.with_progress(activity.status_summary(d.daily, d.tasks, AS_OF))
    return summary.select("user_id", F.round("progress_pct", 6).alias("progress_pct"))


@query
def score_questionnaire(d: StandIns) -> DataFrame:
    """Scored questionnaires; the first items of every tenth one name a domain that no catalogue has."""
    strange = (F.col("assessment_id") % 10 == 0) & (F.col("item_no") == 0)
    answers = d.answers.withColumn("domain", F.when(strange, "Zest").otherwise(F.col("domain")))
    return scoring.score_questionnaire(answers).withColumn("domain_scores", F.to_json("domain_scores"))


@query
def score_answer_map(d: StandIns) -> DataFrame:
    """Questionnaires scored from one map of answers per result."""
    scored = scoring.score_answer_map(d.answer_maps)
    return scored.withColumn("domain_scores", F.to_json("domain_scores"))


@query
def max_scores(d: StandIns) -> DataFrame:
    """Scales of the questionnaires, from the items that were asked."""
    items = d.answers.select("type", "domain", "item_no").distinct()
    return scoring.questionnaire_limits(items)


@query
def score_stroop(d: StandIns) -> DataFrame:
    """Scored reaction tests."""
    return d.stroop.select(
        "id", "user_id", "type", "taken_at", "score", "max_score",
        score_of(F.col("domain_scores"), "avg_time_ms").alias("avg_time_ms"),
    )


@query
def stroop_accuracy(d: StandIns) -> DataFrame:
    """Accuracy and mean time."""
    return scoring.stroop_accuracy(d.good_trials).withColumns(
        {"accuracy_pct": F.round("accuracy_pct", 6), "avg_time_s": F.round("avg_time_s", 6)}
    )


@query
def mean_domain_scores(d: StandIns) -> DataFrame:
    """Domain means over all results."""
    return scoring.mean_domain_scores(d.results).withColumn("mean_score", F.round("mean_score", 6))


@query
def activity_rollup(d: StandIns) -> DataFrame:
    """Counters by user and week with totals."""
    return activity.activity_rollup(d.daily)


@query
def band_distribution(d: StandIns) -> DataFrame:
    """Users per band."""
    return history.band_distribution(d.results)


# --- windows -----------------------------------------------------------------------


@query
def latest_per_type(d: StandIns) -> DataFrame:
    """Newest result per type."""
    return history.latest_per_type(d.results).drop("domain_scores")


@query
def latest_vs_previous(d: StandIns) -> DataFrame:
    """Newest result and the one before."""
    return history.latest_vs_previous(d.results).select(
        "user_id", "type",
        F.col("latest.id").alias("latest_id"), F.col("latest.score").alias("latest_score"),
        F.col("previous.id").alias("previous_id"), F.col("previous.score").alias("previous_score"),
    )


@query
def trend_fit(d: StandIns) -> DataFrame:
    """Trend per user."""
    return trends.trend_fit(durable(d.results.drop("domain_scores"))).withColumns(
        {
            "slope": F.round("slope", 6),
            "intercept": F.round("intercept", 4),
            "fitted": F.round("fitted", 4),
        }
    )


@query
def streak_islands(d: StandIns) -> DataFrame:
    """All runs of active days."""
    return activity.streak_islands(d.daily)


@query
def first_open_task(d: StandIns) -> DataFrame:
    """First active and first pending task."""
    return tasks.first_open_task(d.tasks)


@query
def suggest_next(d: StandIns) -> DataFrame:
    """What to start now."""
    return tasks.suggest_next(d.tasks, profiles.profile_latest_bisbas(d.latest))


@query
def session_gap(d: StandIns) -> DataFrame:
    """Gaps and running minutes."""
    return sessions.session_gap(d.sessions).withColumn("gap_minutes", F.round("gap_minutes", 4))


# --- sorts, limits, sets -------------------------------------------------------------


@query
def recent_assessments(d: StandIns) -> DataFrame:
    """Newest twenty results per user."""
    return history.recent_assessments(d.results, 20).drop("domain_scores")


@query
def recent_sessions(d: StandIns) -> DataFrame:
    """Newest fifty focus records per user."""
    return history.recent_sessions(d.sessions, 50)


@query
def recent_journal(d: StandIns) -> DataFrame:
    """Newest twenty valid journal entries per user."""
    good = validate.valid(validate.strip_journal(d.journal), validate.journal_rules())
    return history.recent_journal(good, 20)


@query
def task_board(d: StandIns) -> DataFrame:
    """The whole board, done tasks included."""
    return tasks.task_board(d.tasks, with_done=True)


@query
def task_snapshot_diff(d: StandIns) -> DataFrame:
    """Tasks before and after done ones are removed and active ones finished."""
    before = d.tasks.select("user_id", "id", "status")
    after = before.filter(F.col("status") != "done").withColumn(
        "status", F.when(F.col("status") == "active", "done").otherwise(F.col("status"))
    )
    return tasks.snapshot_diff(before, after)


# --- bands, profiles, nudges -----------------------------------------------------------


@query
def bdefs_band(d: StandIns) -> DataFrame:
    """Overall bands."""
    own = d.questionnaires.filter(F.col("type") == BDEFS)
    return own.select("id", "score", bands.bdefs_band(F.col("score"), F.col("max_score")).alias("band"))


@query
def domain_band(d: StandIns) -> DataFrame:
    """Bands per domain, shares counted."""
    rows = scoring.explode_domains(d.questionnaires.filter(F.col("type") == BDEFS))
    band = bands.domain_band(F.col("domain"), F.col("domain_score"), F.lit(domain_max(BDEFS)))
    return rows.select("id", "domain", "domain_score", band.alias("band"))


@query
def bisbas_normalise(d: StandIns) -> DataFrame:
    """Totals and domains without their floor; reaction scores stand for unknown domains."""
    totals = d.questionnaires.filter(F.col("type") == BISBAS).select(
        "id", F.lit("total").alias("part"), bands.bisbas_total(F.col("score")).alias("value"),
        F.lit(bands.bisbas_total_range()).alias("value_range"),
    )
    rows = d.results.filter(F.col("type") != BDEFS).select(
        "id", F.explode("domain_scores").alias("part", "score")
    )
    domains = rows.select(
        "id", "part", bands.bisbas_domain_score(F.col("part"), F.col("score")).alias("value"),
        bands.bisbas_domain_range(F.col("part")).alias("value_range"),
    )
    return totals.unionByName(domains)


@query
def bisbas_domain_band(d: StandIns) -> DataFrame:
    """Bands per motivation domain."""
    rows = scoring.explode_domains(d.questionnaires.filter(F.col("type") == BISBAS))
    band = bands.bisbas_domain_band(F.col("domain"), F.col("domain_score"))
    return rows.select("id", "domain", "domain_score", band.alias("band"))


def _bisbas(d: StandIns) -> DataFrame:
    return d.questionnaires.filter(F.col("type") == BISBAS)


@query
def bisbas_profile_codes(d: StandIns) -> DataFrame:
    """Reading codes."""
    codes = bands.bisbas_profile_codes(F.col("score"), F.col("domain_scores"))
    return _bisbas(d).select("id", codes.alias("codes")).select("id", joined("codes"))


@query
def stroop_codes(d: StandIns) -> DataFrame:
    """Accuracy and speed codes."""
    avg = score_of(F.col("domain_scores"), "avg_time_ms")
    return d.stroop.select(
        "id",
        bands.stroop_accuracy_code(F.col("score"), F.col("max_score")).alias("accuracy"),
        bands.stroop_speed_code(avg).alias("speed"),
    )


@query
def bisbas_guidance_codes(d: StandIns) -> DataFrame:
    """Tips and cadence."""
    tips = _bisbas(d).withColumn("tips", bands.bisbas_tip_codes(F.col("domain_scores")))
    paced = profiles.with_bisbas_profile(tips, F.col("domain_scores"))
    return paced.select("id", joined("tips"), "focus_minutes", "break_minutes")


@query
def profile_bisbas(d: StandIns) -> DataFrame:
    """A profile per motivation result."""
    return profiles.profile_bisbas(d.questionnaires)


@query
def profile_latest_bisbas(d: StandIns) -> DataFrame:
    """A profile per user from motivation results."""
    return profiles.profile_latest_bisbas(d.latest)


@query
def profile_blended(d: StandIns) -> DataFrame:
    """A profile per user from all three types."""
    return profiles.profile_blended(d.latest)


@query
def nudge_style_apply(d: StandIns) -> DataFrame:
    """A greeting in the style of each user."""
    message = F.concat(F.lit("Hello, user "), F.col("user_id").cast("string"))
    text = profiles.nudge_text(F.col("nudge_style"), message, PREFIXES)
    return profiles.profile_latest_bisbas(d.latest).select("user_id", "nudge_style", text.alias("nudge"))


@query
def act_gate(d: StandIns) -> DataFrame:
    """Who is offered journal prompts."""
    return profiles.profile_blended(d.latest).select("user_id", profiles.act_gate().alias("offered"))


@query
def act_guidance_code(d: StandIns) -> DataFrame:
    """Which guidance goes with the prompts."""
    return profiles.profile_blended(d.latest).select(
        "user_id", profiles.act_guidance_code().alias("guidance")
    )


@query
def assign_nudge(d: StandIns) -> DataFrame:
    """A bullet of the documents for each active day of each user."""
    bullets = corpus.bullets(corpus.lines(d.markdown, "doc_id", "text"))
    days = d.daily.select("user_id", "date")
    lists = {"nudge": bullets.filter(F.col("line_no") % 3 != 0), "break": bullets.filter(F.col("line_no") % 3 == 0)}
    both = [
        messages.assign_nudge(days, messages.number_messages(own, ["doc_id", "line_no"])).select(
            F.lit(name).alias("list"), "user_id", "date", "number", "message"
        )
        for name, own in lists.items()
    ]
    return both[0].unionByName(both[1])


@query
def history_entries(d: StandIns) -> DataFrame:
    """Typed lines of the newest ten results per user; lines of one part in no order but theirs."""
    entries = history.history_entries(d.results, 10)
    return entries.select("user_id", "id", "rank", "type", "taken_at", F.explode("lines").alias("line")).select(
        "user_id", "id", "rank", "type", "taken_at", "line.*"
    )


@query
def radar_vector(d: StandIns) -> DataFrame:
    """Five scores in order; other types have none of the domains."""
    return d.results.select("id", places(history.radar_vector(F.col("domain_scores")), "value"))


@query
def reserve_pct(d: StandIns) -> DataFrame:
    """Headroom per domain."""
    own = d.questionnaires.filter(F.col("type") == BDEFS)
    rows = own.select("id", places(history.reserve_pct(F.col("domain_scores")), "reserve"))
    return rows.withColumn("reserve", F.round("reserve", 6))


@query
def reserve_delta(d: StandIns) -> DataFrame:
    """Headroom against the result before."""
    return history.reserve_delta(d.pairs).withColumns(
        {"now": F.round("now", 6), "then": F.round("then", 6)}
    )


@query
def reserve_overall(d: StandIns) -> DataFrame:
    """Overall headroom and its direction."""
    rounded = {c: F.round(c, 6) for c in ("reserve", "reserve_before", "delta")}
    return history.reserve_overall(d.pairs).withColumns(rounded)


@query
def bisbas_bars(d: StandIns) -> DataFrame:
    """Four scores without their floor."""
    return _bisbas(d).select("id", places(history.bisbas_bars(F.col("domain_scores")), "value"))


# --- state changes -------------------------------------------------------------------


def _log(d: StandIns) -> DataFrame:
    return d.activity.filter(F.col("kind") != "focus").drop("duration_minutes")


@query
def fold_task_state(d: StandIns) -> DataFrame:
    """Current state of all tasks in the log."""
    return state.fold_task_state(_log(d))


@query
def toggle_task(d: StandIns) -> DataFrame:
    """The log with its reopenings taken for toggles, spelled out."""
    kind = F.col("kind")
    toggled = _log(d).withColumn("kind", F.when(kind == "reopen", "toggle").otherwise(kind))
    return state.expand_toggles(toggled)


@query
def focus_activates_task(d: StandIns) -> DataFrame:
    """Task states once accepted focus sessions have activated their tasks."""
    started = state.activations_from_focus(sessions.reconstruct_sessions(d.timer_events))
    # Both logs come from the same source rows: keep their ids apart.
    key = F.col("event_id")
    log = _log(d).withColumn("event_id", key * 2)
    return state.fold_task_state(log.unionByName(started.withColumn("event_id", key * 2 + 1)))


@query
def delete_task_cascade(d: StandIns) -> DataFrame:
    """Active tasks deleted with all below; the sessions that lose their task are counted."""
    kept, freed = tasks.delete_tasks(
        d.tasks, d.sessions, d.tasks.filter(F.col("status") == "active")
    )
    left = kept.select("user_id", F.lit("task").alias("what"), "id", F.col("parent_id").alias("link"))
    linked = freed.select("user_id", F.lit("session").alias("what"), "id", F.col("task_id").alias("link"))
    return left.unionByName(linked)


@query
def delete_all_tasks(d: StandIns) -> DataFrame:
    """All tasks of users with a day of three completions deleted."""
    busy = d.daily.filter(F.col("tasks_completed") >= 3).select("user_id").distinct()
    kept, left, daily, counts = tasks.delete_all_tasks(d.tasks, d.sessions, d.daily, busy)

    def counted(rows: DataFrame, what: str, value: Column) -> DataFrame:
        return rows.groupBy("user_id").agg(F.lit(what).alias("what"), F.sum(value).alias("n"))

    one = F.lit(1).cast("bigint")
    return (
        counted(kept, "tasks", one)
        .unionByName(counted(left, "sessions", one))
        .unionByName(counted(daily, "completed", F.col("tasks_completed")))
        .unionByName(counted(daily, "minutes", F.col("focus_minutes")))
        .unionByName(counts.select("user_id", F.lit("deleted").alias("what"), F.col("deleted").alias("n")))
    )


@query
def delete_results(d: StandIns) -> DataFrame:
    """Reaction tests below half deleted one by one, with a flag for each asked id."""
    doomed = d.stroop.filter(F.col("score") * 2 < F.col("max_score")).select("user_id", "id")
    missing = doomed.withColumn("id", -F.col("id") - 1)
    kept, outcome = tasks.delete_rows(d.results, doomed.unionByName(missing), ["user_id", "id"])
    flags = outcome.select("user_id", "id", F.when(F.col("deleted"), "deleted").otherwise("absent").alias("state"))
    return kept.select("user_id", "id", F.lit("kept").alias("state")).unionByName(flags)


@query
def delete_all_results(d: StandIns) -> DataFrame:
    """All results of every third user deleted, beside the number deleted."""
    users = d.results.filter(F.col("user_id") % 3 == 0).select("user_id").distinct()
    kept, counts = tasks.delete_all_results(d.results, users)
    left = kept.groupBy("user_id").agg(F.lit("kept").alias("state"), F.count(F.lit(1)).alias("n"))
    return left.unionByName(counts.select("user_id", F.lit("deleted").alias("state"), F.col("deleted").alias("n")))


@query
def delete_session(d: StandIns) -> DataFrame:
    """Focus records of under ten minutes deleted by id; counters stay as they are."""
    doomed = d.sessions.filter(F.col("duration_minutes") < 10).select("user_id", "id")
    kept, outcome = tasks.delete_rows(d.sessions, doomed, ["user_id", "id"])
    flags = outcome.select("user_id", "id", F.when(F.col("deleted"), "deleted").otherwise("absent").alias("state"))
    return kept.select("user_id", "id", F.lit("kept").alias("state")).unionByName(flags)


@query
def delete_entries(d: StandIns) -> DataFrame:
    """Days without completions deleted; counters of other days stay as they are."""
    doomed = d.daily.filter(F.col("tasks_completed") == 0).select("user_id", "date")
    kept, outcome = tasks.delete_rows(d.daily, doomed, ["user_id", "date"])
    flags = outcome.select(
        "user_id", "date", F.lit(None).cast("bigint").alias("tasks_completed"),
        F.lit(None).cast("bigint").alias("focus_minutes"), F.lit("deleted").alias("state"),
    )
    return kept.withColumn("state", F.lit("kept")).unionByName(flags)


# --- streams and sessions ---------------------------------------------------------------


def _event_stream(d: StandIns) -> DataFrame:
    schema = d.table("events").schema
    return stream_activity.read_events(d.spark, d.folder, schema, "events.parquet")


def _activity_stream(d: StandIns) -> DataFrame:
    return valid_activity(with_activity_columns(_event_stream(d)))


@query
def stream_daily_activity(d: StandIns) -> DataFrame:
    """Daily counters by stream."""
    rows = stream_activity.stream_daily_activity(_activity_stream(d))
    path = sink.run_sums(rows, "daily", ["user_id", "date"], stream_activity.COUNTERS)
    schema = "user_id bigint, date date, tasks_completed bigint, focus_minutes bigint"
    return sink.read_sums(d.spark, path, schema, ["user_id", "date"])


@query
def stream_weekly_activity(d: StandIns) -> DataFrame:
    """Weekly counters by stream."""
    rows = stream_activity.stream_weekly_activity(_activity_stream(d))
    path = sink.run_sums(rows, "weekly", ["user_id", "week"], stream_activity.COUNTERS)
    schema = "user_id bigint, week date, tasks_completed bigint, focus_minutes bigint"
    return sink.read_sums(d.spark, path, schema, ["user_id", "week"])


@query
def stream_daily_windows(d: StandIns) -> DataFrame:
    """Daily counters by event-time windows under a watermark."""
    path = sink.run_available(stream_activity.stream_windows(_activity_stream(d))[0], "daily-windows")
    schema = "user_id bigint, date date, tasks_completed bigint, focus_minutes bigint"
    return sink.read_current(d.spark, path, schema, ["user_id", "date"])


@query
def stream_weekly_windows(d: StandIns) -> DataFrame:
    """Weekly counters by event-time windows under a watermark."""
    path = sink.run_available(stream_activity.stream_windows(_activity_stream(d))[1], "weekly-windows")
    schema = "user_id bigint, week date, tasks_completed bigint, focus_minutes bigint"
    return sink.read_current(d.spark, path, schema, ["user_id", "week"])


@query
def stream_latest_profile(d: StandIns) -> DataFrame:
    """Profiles by stream over the stored results."""
    folder = new_folder(d.spark, "results")
    d.results.write.parquet(folder)
    results = d.spark.readStream.schema(d.results.schema).parquet(folder)
    changes = stream_profiles.stream_latest_profile(results)
    path = sink.run_available(changes, "profiles")
    schema = (
        "user_id bigint, focus_minutes int, break_minutes int, nudge_style string, "
        "suggest_breakdown boolean, encourage_reward boolean, add_reassurance boolean"
    )
    return sink.read_current(d.spark, path, schema, ["user_id"])


@query
def stream_dedup(d: StandIns) -> DataFrame:
    """Events sent twice, kept once."""
    doubled = _event_stream(d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = stream_activity.stream_dedup(doubled).select("event_id", "user_id", "event_type")
    path = sink.run_available(once, "dedup", "append")
    return sink.read_appended(d.spark, path, "event_id bigint, user_id bigint, event_type string")


@query
def stream_sessions(d: StandIns) -> DataFrame:
    """Sessions by stream, what waits behind the watermark included once the stream is over."""
    path, progress = new_folder(d.spark, "sessions"), new_folder(d.spark, "sessions-progress")
    stream_timers.stream_sessions(with_timer_columns(_event_stream(d)), path, progress).awaitTermination()
    return stream_timers.whole_sessions(d.spark, path)


@query
def stream_sessions_settled(d: StandIns) -> DataFrame:
    """Sessions by a stream that meets every other event when the rest is over, put in afterwards."""
    log, stored = d.timer_events, new_folder(d.spark, "timer-log")
    path, progress = new_folder(d.spark, "sessions"), new_folder(d.spark, "sessions-progress")
    for half in (1, 0):
        log.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(stored)
        stream = stream_activity.read_events(d.spark, stored, log.schema)
        stream_timers.stream_sessions(stream, path, progress).awaitTermination()
    stream_timers.settle_late(log, path)
    return stream_timers.whole_sessions(d.spark, path)


@query
def stream_chains(d: StandIns) -> DataFrame:
    """Chains of alternating sessions by stream, the open ones included once the stream is over."""
    path, progress = new_folder(d.spark, "chains"), new_folder(d.spark, "chains-progress")
    events = with_timer_columns(_event_stream(d))
    stream_chain_folds.stream_chains(events, path, progress, gap_seconds=600).awaitTermination()
    return stream_chain_folds.whole_chains(d.spark, path, gap_seconds=600)


@query
def reconstruct_sessions(d: StandIns) -> DataFrame:
    """Sessions from the whole timer log."""
    return sessions.reconstruct_sessions(d.timer_events)


@query
def auto_cycle_chains(d: StandIns) -> DataFrame:
    """Chains of alternating sessions at most ten minutes apart."""
    return sessions.auto_cycle_chains(
        durable(sessions.reconstruct_sessions(d.timer_events)), gap_seconds=600
    )

