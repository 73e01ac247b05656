"""Explicit schemas of the record tables; nothing is inferred."""

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    owner = T.StructField("user_id", T.LongType(), False)
    return T.StructType([owner, *(T.StructField(*f) for f in fields)])


TASKS = _table(
    ("id", T.LongType(), False),
    ("title", T.StringType(), False),
    ("parent_id", T.LongType(), True),
    ("status", T.StringType(), False),
    ("created_at", T.TimestampNTZType(), False),
    ("completed_at", T.TimestampNTZType(), True),
)

FOCUS_SESSIONS = _table(
    ("id", T.LongType(), False),
    ("task_id", T.LongType(), True),
    ("duration_minutes", T.IntegerType(), False),
    ("completed_at", T.TimestampNTZType(), False),
)

DAILY_LOG = _table(
    ("date", T.DateType(), False),
    ("tasks_completed", T.LongType(), False),
    ("focus_minutes", T.LongType(), False),
)

ASSESSMENTS = _table(
    ("id", T.LongType(), False),
    ("type", T.StringType(), False),
    ("score", T.IntegerType(), False),
    ("max_score", T.IntegerType(), False),
    ("domain_scores", T.MapType(T.StringType(), T.IntegerType()), False),
    ("taken_at", T.TimestampNTZType(), False),
)

JOURNAL = _table(
    ("id", T.LongType(), False),
    ("values_focus", T.StringType(), False),
    ("challenge_context", T.StringType(), False),
    ("thoughts_feelings", T.StringType(), False),
    ("defusion_reframe", T.StringType(), False),
    ("committed_action", T.StringType(), False),
    ("created_at", T.TimestampNTZType(), False),
)

TABLES = {
    "tasks": TASKS,
    "focus_sessions": FOCUS_SESSIONS,
    "daily_log": DAILY_LOG,
    "assessments": ASSESSMENTS,
    "act_journal_entries": JOURNAL,
}


RAW_LINE = "raw_line"


def text_form(schema: T.StructType) -> T.StructType:
    """The same columns as text, and ``raw_line`` for lines that cannot be read at all."""
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema.fields]
    return T.StructType([*fields, T.StructField(RAW_LINE, T.StringType(), True)])
