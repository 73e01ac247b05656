"""Timer sessions rebuilt from start, pause and stop events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import MICROS_PER_SECOND, from_micros, micros
from cairn.operators import ordered, timer_chain
from cairn.operators.validate import reasons, timer_plan_rules
from cairn.session import durable

#: A chunk that spans several sessions is rarely begun wrongly twice, however many events share an instant.
FOLD_ROWS = 8192

_SESSION = (
    "struct<start_event_id:bigint,task_id:bigint,is_break:boolean,planned_minutes:int,"
    "started:bigint,ended:bigint,active:bigint,outcome:string>"
)
# left: microseconds still to run; resumed: since when it runs, null while paused.
_TIMER = (
    "struct<start_event_id:bigint,task_id:bigint,is_break:boolean,planned_minutes:int,"
    "started:bigint,left:bigint,resumed:bigint>"
)


def _total(timer: Column) -> Column:
    return timer["planned_minutes"].cast("bigint") * 60 * MICROS_PER_SECOND


def _close(timer: Column, ended: Column, left: Column, outcome: str) -> Column:
    return F.struct(
        timer["start_event_id"].alias("start_event_id"),
        timer["task_id"].alias("task_id"),
        timer["is_break"].alias("is_break"),
        timer["planned_minutes"].alias("planned_minutes"),
        timer["started"].alias("started"),
        ended.alias("ended"),
        (_total(timer) - left).alias("active"),
        F.lit(outcome).alias("outcome"),
    ).cast(_SESSION)


def _set(timer: Column, left: Column, resumed: Column) -> Column:
    return F.struct(
        timer["start_event_id"].alias("start_event_id"),
        timer["task_id"].alias("task_id"),
        timer["is_break"].alias("is_break"),
        timer["planned_minutes"].alias("planned_minutes"),
        timer["started"].alias("started"),
        left.alias("left"),
        resumed.alias("resumed"),
    ).cast(_TIMER)


def _begin(event: Column) -> Column:
    total = event["planned_minutes"].cast("bigint") * 60 * MICROS_PER_SECOND
    return F.struct(
        event["event_id"].alias("start_event_id"),
        event["task_id"].alias("task_id"),
        event["is_break"].alias("is_break"),
        event["planned_minutes"].alias("planned_minutes"),
        event["at"].alias("started"),
        total.alias("left"),
        event["at"].alias("resumed"),
    ).cast(_TIMER)


def _ends(timer: Column) -> Column:
    return timer["resumed"] + timer["left"]


def _step(state: Column, event: Column) -> Column:
    """One event: a timer that has run out closes first, then the event acts."""
    none = F.lit(None)
    timer, now, kind = state["timer"], event["at"], event["kind"]
    over = F.coalesce(timer["resumed"].isNotNull() & (_ends(timer) <= now), F.lit(False))
    live = timer.isNotNull() & ~over
    running = live & timer["resumed"].isNotNull()
    left = F.when(running, timer["left"] - (now - timer["resumed"])).otherwise(timer["left"])

    next_timer = (
        F.when(live & (kind == "stop"), none.cast(_TIMER))
        .when(
            live & (kind == "toggle"),
            _set(timer, left, F.when(running, none.cast("bigint")).otherwise(now)),
        )
        .when(live, timer)
        .when(kind == "start", _begin(event))
    )
    closed = F.when(over, _close(timer, _ends(timer), F.lit(0).cast("bigint"), "completed")).when(
        live & (kind == "stop"), _close(timer, now, left, "stopped")
    )
    done = F.when(closed.isNotNull(), F.array_append(state["done"], closed)).otherwise(state["done"])
    return F.struct(next_timer.cast(_TIMER).alias("timer"), done.alias("done"))


def _fold(chunks: DataFrame, turn: int) -> DataFrame:
    """Run each chunk's events from its entry timer: adds ``done`` and ``exit``."""
    start = F.struct(
        F.col("entry").alias("timer"), F.array().cast(f"array<{_SESSION}>").alias("done")
    )
    folded = chunks.withColumn("folded", F.aggregate("events", start, _step))
    return folded.select(
        "user_id", "chunk", "inert", "upto", F.lit(turn).alias("turn"), "entry",
        F.col("folded.done").alias("done"), F.col("folded.timer").alias("exit"),
    )


_ENDS = ("inert", "upto", "entry", "exit")


def _newest(folds: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """Each chunk as it was folded last; only ``columns`` are read."""
    if len(folds) == 1:
        return folds[0].select("user_id", "chunk", *columns)
    every = folds[0]
    for fold in folds[1:]:
        every = every.unionByName(fold)
    newest = F.max_by(F.struct(*columns), "turn").alias("v")
    return every.groupBy("user_id", "chunk").agg(newest).select("user_id", "chunk", "v.*")


def _entries(ends: DataFrame, many: bool) -> DataFrame:
    """Chunks that began wrongly, with the timer the chunks before them left set.

    A paused timer sits through chunks that hold starts only, so it is carried
    over any number of them at once. So is a running one, from the first wrong
    chunk of a user to the chunk in which it ends. ``many`` tells that some user
    has too many chunks for a plain window.
    """
    if many:
        before = ordered.scan(
            ends, ["user_id"], ["chunk"], before=ordered.previous(F.struct("exit", "inert"))
        )
        acted = F.when(~F.col("before.inert"), F.struct("before.exit"))
        known = ordered.scan(before, ["user_id"], ["chunk"], acting=ordered.latest(acted))
    else:
        order = Window.partitionBy("user_id").orderBy("chunk")
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        acted = F.when(~F.col("inert"), F.struct("exit"))
        known = ends.withColumns(
            {
                "before": F.lag(F.struct("exit", "inert")).over(order),
                "acting": F.last(acted, ignorenulls=True).over(earlier),
            }
        )
    paused = F.col("acting.exit").isNotNull() & F.col("acting.exit.resumed").isNull()
    wanted = F.when(paused, F.col("acting.exit")).otherwise(F.col("before.exit"))
    differs = ~F.col("wanted").eqNullSafe(F.col("entry"))
    stale = durable(
        known.withColumn("wanted", wanted).filter(differs).select("user_id", "chunk", "wanted"), "stale"
    )
    first = stale.groupBy("user_id").agg(
        F.min("chunk").alias("begin"), F.min_by("wanted", "chunk").alias("timer")
    )
    running = first.filter(F.col("timer.resumed").isNotNull())
    later = ends.join(running, "user_id").filter("chunk >= begin")
    sits = F.col("inert") & (F.col("upto") < _ends(F.col("timer")))
    reach = later.groupBy("user_id").agg(
        F.first("begin").alias("begin"), F.first("timer").alias("timer"),
        F.coalesce(F.min(F.when(~sits, F.col("chunk"))), F.max("chunk")).alias("last"),
    )
    spans = durable(reach, "leaps")
    carried = ends.join(spans, "user_id").filter("chunk between begin and last").withColumn(
        "wanted", F.col("timer")
    ).filter(differs).select("user_id", "chunk", "wanted")
    rest = stale.join(spans, "user_id", "left").filter("begin is null or chunk > last")
    return carried.unionByName(rest.select("user_id", "chunk", "wanted"))


def accepted_events(events: DataFrame) -> DataFrame:
    """Starts of 1..120 minutes, toggles and stops."""
    refused = (F.col("kind") == "start") & (F.size(reasons(timer_plan_rules())) > 0)
    return events.filter(F.col("kind").isin("start", "toggle", "stop") & ~refused)


def fold_log(
    events: DataFrame, timers: DataFrame | None = None,
    chunk_rows: int = FOLD_ROWS, chunk_limit: int = ordered.PLAIN_LIMIT, turns: int | None = None,
) -> list[DataFrame] | None:
    """The log folded in chunks, each from the timer the one before left: all folds, newest last.

    None if that is not done after ``turns`` turns, where a number is given.

    ``timers`` are (user_id, timer) that are set before the log begins. Every
    turn writes the chunks that it folds again and no others; ``_newest`` puts
    the turns together.
    """
    # Read once, by the table of chunks, so positions need not be written down before.
    placed = ordered.placed(accepted_events(events), ["user_id"], ["ts", "event_id"], chunk_rows)
    event = F.struct(
        "_pos", "event_id", micros(F.col("ts")).alias("at"), "kind",
        "planned_minutes", "is_break", "task_id",
    )
    chunks = durable(
        placed.groupBy("user_id", F.col("_chunk").alias("chunk")).agg(
            F.sort_array(F.collect_list(event)).alias("events"),
            F.every(F.col("kind") == "start").alias("inert"),
            F.max(micros(F.col("ts"))).alias("upto"),
        ),
        "timer-chunks",
    )
    many = not ordered.large_keys(chunks, ["user_id"], chunk_limit).isEmpty()
    none = F.lit(None).cast(_TIMER)
    folded = _fold(chunks.withColumn("entry", none), 0)
    if timers is not None:
        seeds = timers.select(
            "user_id", F.lit(-1).cast("bigint").alias("chunk"), F.lit(False).alias("inert"),
            F.lit(None).cast("bigint").alias("upto"), F.lit(0).alias("turn"), none.alias("entry"),
            F.array().cast(f"array<{_SESSION}>").alias("done"), F.col("timer").cast(_TIMER).alias("exit"),
        )
        folded = folded.unionByName(seeds)
    folds = [durable(folded, "folded")]
    while True:
        stale = durable(_entries(_newest(folds, _ENDS), many), "stale")
        if stale.isEmpty():
            return folds
        if turns is not None and len(folds) > turns:
            return None
        again = chunks.join(stale, ["user_id", "chunk"]).withColumnRenamed("wanted", "entry")
        folds.append(durable(_fold(again, len(folds)), "folded"))


#: Turns in which most logs are folded; others are not folded any further.
FOLD_TURNS = 6


def reconstruct_sessions(
    events: DataFrame, chunk_rows: int = FOLD_ROWS, chunk_limit: int = ordered.PLAIN_LIMIT, turns: int = FOLD_TURNS
) -> DataFrame:
    """Sessions from ``(user_id, event_id, ts, kind, planned_minutes, is_break, task_id)``.

    A start while a timer is set is ignored; ``toggle`` pauses and resumes and
    is ignored when idle; paused time does not count; ``stop`` ends a session
    unfinished. A running timer whose log ends here runs out; a paused one is
    ``open``. Starts outside 1..120 minutes are not accepted.

    What a start means depends on whether an earlier timer is over, so rows are
    folded in order, in chunks of bounded size, never a user at once. All chunks
    first assume that they begin idle; those whose predecessor left a timer set
    are folded again from it. Nearly all logs come to rest within a few such
    turns, as every idle moment does. One that does not after ``turns`` turns,
    such as starts without a pause for days, is left to :func:`chained_sessions`,
    whose turns grow with the logarithm of the log only. Both give the same rows.
    """
    folds = fold_log(events, None, chunk_rows, chunk_limit, turns)
    if folds is None:
        return chained_sessions(events, chunk_limit=chunk_limit)
    return sessions_of(closed_in(folds).unionByName(run_out(timers_after(folds))))


def chained_sessions(
    events: DataFrame, chunk_starts: int = timer_chain.CHUNK_STARTS, chunk_limit: int = ordered.PLAIN_LIMIT
) -> DataFrame:
    """The same without folding: every start is given the end it would have, and pointers between starts double.

    The number of Spark jobs grows with the logarithm of the log's chunks,
    whatever the log holds; see :mod:`cairn.operators.timer_chain`.
    """
    found = timer_chain.sessions_in(accepted_events(events), chunk_starts=chunk_starts, limit=chunk_limit)
    return sessions_of(found.select("user_id", F.struct(
        F.col("event_id").alias("start_event_id"), "task_id", "is_break", "planned_minutes", F.col("at").alias("started"),
        "ended", (F.col("total") - F.col("left")).alias("active"), "outcome",
    ).cast(_SESSION).alias("s")))


def closed_in(folds: list[DataFrame]) -> DataFrame:
    """(user_id, s): sessions that ended within the log."""
    return _newest(folds, ("done",)).select("user_id", F.explode("done").alias("s"))


def timers_after(folds: list[DataFrame]) -> DataFrame:
    """(user_id, timer): timers that are set when the log ends."""
    last = _newest(folds, ("exit",)).groupBy("user_id").agg(F.max_by("exit", "chunk").alias("timer"))
    return last.filter(F.col("timer").isNotNull())


def timer_end() -> Column:
    """When a running ``timer`` runs out, in microseconds; null for a paused one."""
    return _ends(F.col("timer"))


def run_out(timers: DataFrame) -> DataFrame:
    """(user_id, s): running timers completed at their end, paused ones open."""
    timer = F.col("timer")
    end = (
        F.when(timer["resumed"].isNotNull(), _close(timer, _ends(timer), F.lit(0).cast("bigint"), "completed"))
        .otherwise(_close(timer, F.lit(None).cast("bigint"), timer["left"], "open"))
    )
    return timers.select("user_id", end.alias("s"))


def sessions_of(closed: DataFrame) -> DataFrame:
    """Session columns of (user_id, s)."""
    completed = F.col("s.outcome") == "completed"
    return closed.select(
        "user_id",
        F.col("s.start_event_id").alias("start_event_id"),
        F.col("s.task_id").alias("task_id"),
        F.col("s.is_break").alias("is_break"),
        F.col("s.planned_minutes").alias("planned_minutes"),
        from_micros(F.col("s.started")).alias("started_at"),
        from_micros(F.col("s.ended")).alias("ended_at"),
        F.col("s.outcome").alias("outcome"),
        completed.alias("completed"),
        F.expr(f"s.active div {MICROS_PER_SECOND}").alias("elapsed_seconds"),
        (F.col("s.planned_minutes") * 60).cast("bigint").alias("total_seconds"),
        F.when(completed & ~F.col("s.is_break"), F.col("s.planned_minutes"))
        .otherwise(0).alias("logged_minutes"),
    )


def logged_focus(sessions: DataFrame) -> DataFrame:
    """Focus records of completed focus sessions; breaks and unfinished ones log nothing."""
    return sessions.filter(F.col("logged_minutes") > 0).select(
        "user_id",
        F.col("start_event_id").alias("id"),
        "task_id",
        F.col("logged_minutes").alias("duration_minutes"),
        F.col("ended_at").alias("completed_at"),
    )


def session_gap(sessions: DataFrame, **sizes: int) -> DataFrame:
    """Minutes since the previous session's end and running focus minutes, per user.

    ``sessions`` are stored focus records; a session begins its duration before
    it was completed.
    """
    known = ordered.scan(
        sessions, ["user_id"], ["completed_at", "id"],
        previous_at=ordered.previous(F.col("completed_at")),
        running_minutes=ordered.total(F.col("duration_minutes").cast("bigint")),
        **sizes,
    )
    apart = micros(F.col("completed_at")) - micros(F.col("previous_at"))
    return known.withColumn("gap_minutes", apart / (60 * MICROS_PER_SECOND))


_FIRST = ["started_at", "start_event_id"]


def chain_pieces(sessions: DataFrame) -> DataFrame:
    """Every session as a chain of its own, to be joined by :func:`joined_chains`."""
    focus = ~F.col("is_break")
    return sessions.select(
        "user_id", *_FIRST, "ended_at",
        F.col("is_break").alias("first_break"), F.col("is_break").alias("last_break"), F.col("completed").alias("last_completed"),
        F.lit(1).cast("bigint").alias("sessions"),
        F.coalesce(focus & F.col("completed"), F.lit(False)).cast("bigint").alias("focus_blocks"),
        F.col("logged_minutes").cast("bigint").alias("focus_minutes"),
        F.when(focus & F.col("task_id").isNotNull(), F.struct(*_FIRST, "task_id")).alias("task"),
    )


def joined_chains(pieces: DataFrame, gap_seconds: float = 1.0, **sizes: int) -> DataFrame:
    """Chains put together from consecutive pieces of them, of any length; ``chain`` numbers a user's from 1.

    Pieces have the columns of :func:`chain_pieces`, and so has the result: what
    is joined may be joined with later pieces again.
    """
    seen = ordered.scan(
        pieces, ["user_id"], _FIRST,
        before=ordered.previous(F.struct("ended_at", "last_break", "last_completed")), **sizes,
    )
    gap = micros(F.col("started_at")) - micros(F.col("before.ended_at"))
    follows = (
        F.col("before.last_completed")
        & (F.col("before.last_break") != F.col("first_break"))
        & (gap <= int(gap_seconds * MICROS_PER_SECOND))
    )
    begins = (~F.coalesce(follows, F.lit(False))).cast("int")
    numbered = ordered.scan(
        seen.withColumn("_begins", begins), ["user_id"], _FIRST,
        chain=ordered.total(F.col("_begins")), **sizes,
    )
    place = F.struct(*_FIRST)
    return numbered.groupBy("user_id", "chain").agg(
        F.min("started_at").alias("started_at"),
        F.min_by("start_event_id", place).alias("start_event_id"),
        F.max("ended_at").alias("ended_at"),
        F.min_by("first_break", place).alias("first_break"),
        F.max_by("last_break", place).alias("last_break"),
        F.max_by("last_completed", place).alias("last_completed"),
        F.sum("sessions").alias("sessions"),
        F.sum("focus_blocks").alias("focus_blocks"),
        F.sum("focus_minutes").alias("focus_minutes"),
        F.min("task").alias("task"),
    )


#: What callers see of a chain.
CHAIN_COLUMNS = ("started_at", "ended_at", "sessions", "focus_blocks", "focus_minutes")


def auto_cycle_chains(sessions: DataFrame, gap_seconds: float = 1.0, **sizes: int) -> DataFrame:
    """Chains in which a completed session hands over to one of the other kind.

    ``sessions`` come from :func:`reconstruct_sessions`. The next one belongs to
    the chain when it starts within ``gap_seconds`` of the end of a completed
    session and focus and break alternate.
    """
    found = joined_chains(chain_pieces(sessions), gap_seconds, **sizes)
    return found.select("user_id", "chain", *CHAIN_COLUMNS, F.col("task.task_id").alias("task_id"))
