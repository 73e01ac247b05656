"""Short ways to build inputs and read results."""

from __future__ import annotations

import datetime as dt

ASSESSMENTS = (
    "id bigint, user_id bigint, type string, taken_at timestamp_ntz, score int, max_score int, "
    "domain_scores map<string,int>"
)
TASKS = (
    "user_id bigint, id bigint, title string, parent_id bigint, status string, "
    "created_at timestamp_ntz, completed_at timestamp_ntz"
)
DAILY = "user_id bigint, date date, tasks_completed bigint, focus_minutes bigint"
LOG = "user_id bigint, task_id bigint, event_id bigint, ts timestamp_ntz, kind string"
TIMER = (
    "user_id bigint, event_id bigint, ts timestamp_ntz, kind string, planned_minutes int, "
    "is_break boolean, task_id bigint"
)
SESSIONS = (
    "user_id bigint, id bigint, task_id bigint, duration_minutes int, completed_at timestamp_ntz"
)


def at(day: str, clock: str = "00:00:00") -> dt.datetime:
    """A moment."""
    return dt.datetime.fromisoformat(f"{day}T{clock}")


def day(text: str) -> dt.date:
    """A date."""
    return dt.date.fromisoformat(text)


def rows(df, *columns: str) -> list[tuple]:
    """Sorted rows as tuples, nulls first."""
    picked = df.select(*columns) if columns else df
    found = [tuple(r) for r in picked.collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


def bisbas(bis: int, drive: int, reward: int, fun: int) -> dict[str, int]:
    """A motivation score map."""
    from cairn.catalogue import BISBAS_DOMAINS

    return dict(zip(BISBAS_DOMAINS, (bis, drive, reward, fun)))
