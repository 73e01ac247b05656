"""Text rows to typed rows and back. What cannot be decoded is kept, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.catalogue import ASSESSMENT_TYPES, TASK_STATUSES
from cairn.functions.columns import present
from cairn.schemas import RAW_LINE

# The accepted date-time text, day and optional time without a zone.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def iso_timestamp(text: Column) -> Column:
    """A zone-free timestamp, null when the text is not one."""
    return F.when(text.rlike(ISO), text.try_cast("timestamp_ntz"))


def _when_bad(bad: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(code))


def _whole(rows: DataFrame, name: str, kind: str = "bigint", needed: bool = True) -> tuple[Column, Column]:
    """A whole number out of text, and its reason when that text is none.

    Columns that are numbers already pass. An empty text is no number, and bad
    only where one is ``needed``.
    """
    value = F.col(name).try_cast(kind)
    given = F.coalesce(F.trim(F.col(name).cast("string")) != "", F.lit(False))
    return value, _when_bad(value.isNull() & (given | F.lit(needed)), name)


def _decode(
    rows: DataFrame, typed: dict[str, Column], checks: list[Column],
    numbers: dict[str, tuple[str, bool]],
) -> DataFrame:
    """Typed columns and ``reasons``; the text of every column with a reason is kept in ``raw``.

    A line that could not be read at all has the one reason ``line`` and stays
    whole in ``raw_line``.
    """
    made = {name: _whole(rows, name, *how) for name, how in numbers.items()}
    typed = {**typed, **{name: value for name, (value, _) in made.items()}}
    broken = F.col(RAW_LINE).isNotNull() if RAW_LINE in rows.columns else F.lit(False)
    found = F.array_distinct(present([reason for _, reason in made.values()] + checks))
    reasons = F.when(broken, F.array(F.lit("line"))).otherwise(found)
    texts = F.map_from_arrays(
        F.array(*[F.lit(c) for c in rows.columns if c != RAW_LINE]),
        F.array(*[F.col(c).cast("string") for c in rows.columns if c != RAW_LINE]),
    )
    raw = F.map_filter(texts, lambda name, _: F.array_contains(F.col("reasons"), name))
    return rows.withColumn("reasons", reasons).withColumn("raw", raw).withColumns(typed)


_IDS = {"user_id": ("bigint", True), "id": ("bigint", True)}


def decode_tasks(rows: DataFrame) -> DataFrame:
    """Ids, status and times of tasks; an empty parent or completion time is none."""
    created, done = iso_timestamp(F.col("created_at")), iso_timestamp(F.col("completed_at"))
    given = F.coalesce(F.length("completed_at"), F.lit(0)) > 0
    known = F.col("status").isin(*TASK_STATUSES)
    return _decode(
        rows,
        {"created_at": created, "completed_at": done},
        [
            _when_bad(~known, "status"),
            _when_bad(created.isNull(), "created_at"),
            _when_bad(given & done.isNull(), "completed_at"),
        ],
        {**_IDS, "parent_id": ("bigint", False)},
    )


def decode_sessions(rows: DataFrame) -> DataFrame:
    """Numbers and completion time of focus sessions; the duration must be above 0."""
    done = iso_timestamp(F.col("completed_at"))
    return _decode(
        rows,
        {"completed_at": done},
        [
            _when_bad(F.col("duration_minutes").try_cast("int") <= 0, "duration_minutes"),
            _when_bad(done.isNull(), "completed_at"),
        ],
        {**_IDS, "task_id": ("bigint", False), "duration_minutes": ("int", False)},
    )


def decode_assessments(rows: DataFrame) -> DataFrame:
    """Numbers, score map, type and time of results."""
    scores = F.from_json("domain_scores", "map<string,int>")
    taken = iso_timestamp(F.col("taken_at"))
    bad_map = scores.isNull() | F.exists(F.map_values(scores), lambda v: v.isNull())
    return _decode(
        rows,
        {"domain_scores": scores, "taken_at": taken},
        [
            _when_bad(~F.col("type").isin(*ASSESSMENT_TYPES), "type"),
            _when_bad(F.col("score").try_cast("int") < 0, "score"),
            _when_bad(F.col("max_score").try_cast("int") <= 0, "max_score"),
            _when_bad(bad_map, "domain_scores"),
            _when_bad(taken.isNull(), "taken_at"),
        ],
        {**_IDS, "score": ("int", False), "max_score": ("int", False)},
    )


def decode_journal(rows: DataFrame) -> DataFrame:
    """Ids and time of journal entries."""
    created = iso_timestamp(F.col("created_at"))
    return _decode(rows, {"created_at": created}, [_when_bad(created.isNull(), "created_at")], _IDS)


def split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the quarantine."""
    good = decoded.filter(F.size("reasons") == 0).drop("reasons", "raw", RAW_LINE)
    return good, decoded.filter(F.size("reasons") > 0)


def iso_text(ts: Column) -> Column:
    """Date-time text with a ``T``, fractions only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def encode_assessments(results: DataFrame) -> DataFrame:
    """Results with the score map as a JSON object and the time as text."""
    return results.withColumns(
        {"domain_scores": F.to_json("domain_scores"), "taken_at": iso_text(F.col("taken_at"))}
    )


def encode_times(rows: DataFrame) -> DataFrame:
    """Any record table with its timestamps as text."""
    times = [f.name for f in rows.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({name: iso_text(F.col(name)) for name in times})
