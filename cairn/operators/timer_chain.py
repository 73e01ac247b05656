"""Timer sessions of a whole log in logarithmically many turns.

What a start means depends on whether an earlier session is over, but how a
session ends does not depend on any other start: it runs out, is stopped, or is
paused and resumed by the toggles after it. So every start is given the end it
would have, if accepted, and the first start that could follow it:

1. Stops and toggles of a user are numbered from the last. Sums of the time
   between them, apart for even and odd numbers, tell in one search after which
   toggle a paused session has run its minutes.
2. Starts point to the first start at or after their end. Chunks of consecutive
   starts follow those pointers inside; pointers from one chunk to a later one
   double, so the starts that a user's first one leads to are known after as
   many turns as the logarithm of the number of chunks.
3. Each chunk marks its accepted starts from where the chain enters it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import MICROS_PER_SECOND, micros
from cairn.operators import ordered
from cairn.session import durable

#: Starts that a chunk follows at once.
CHUNK_STARTS = 512


def _kept(df: DataFrame, label: str, limit: int | None = None, **_: int) -> DataFrame:
    """A table that scans of large keys read twice is written; one that plain windows read once is not."""
    return df if limit is None else durable(df, label)


def _acting(events: DataFrame, **sizes: int) -> DataFrame:
    """Stops and toggles with what a session that meets them needs to know.

    ``number`` counts from the user's last one; ``even`` and ``odd`` are the
    time between neighbours summed up to the one after this, apart by number;
    ``halt`` is the first stop from here on, with the sums up to it; ``last`` is
    the user's last one.
    """
    acts = _kept(events.filter("kind <> 'start'").select("user_id", "pos", "at", "kind"), "acting", **sizes)
    back = [F.col("pos").desc()]
    acts = ordered.scan(acts, ["user_id"], back, number=ordered.total(F.lit(1)), then=ordered.previous(F.col("at")), **sizes)
    acts = _kept(acts.withColumn("gap", F.coalesce(F.col("then") - F.col("at"), F.lit(0))), "acting", **sizes)
    own = {name: F.when(F.col("number") % 2 == odd, F.col("gap")).otherwise(0) for odd, name in enumerate(("even", "odd"))}
    acts = ordered.scan(acts, ["user_id"], ["pos"], **{k: ordered.total(v) for k, v in own.items()}, **sizes)
    acts = _kept(acts, "acting", **sizes)
    halt = F.when(F.col("kind") == "stop", F.struct("pos", "at", *[(F.col(k) - v).alias(k) for k, v in own.items()]))
    last = F.when(F.col("number") == 1, F.struct("at", "even", "odd"))
    return durable(ordered.scan(acts, ["user_id"], back, halt=ordered.latest(halt), last=ordered.latest(last), **sizes), "acting")


def _of_parity(row: Column, parity: Column) -> Column:
    return F.when(parity == 0, row["even"]).otherwise(row["odd"])


def ends(events: DataFrame, **sizes: int) -> DataFrame:
    """All starts with the end they would have: ``ended`` (null while paused for good), ``left`` and ``outcome``.

    ``events`` is a stored table of (user_id, pos, at, kind, minutes) with
    positions in order; ``closed`` is the position of the stop that ends a start.
    """
    starts = events.filter("kind = 'start'").select("user_id", "pos", "at", "minutes", F.lit(None).cast("string").alias("kind"))
    acts = _acting(events, **sizes)
    facts = ("pos", "at", "kind", "number", "even", "odd", "halt", "last")
    both = _kept(starts.unionByName(acts.select("user_id", *facts), allowMissingColumns=True), "log", **sizes)
    act = F.when(F.col("kind").isNotNull(), F.struct(*facts))
    seen = ordered.scan(both, ["user_id"], [F.col("pos").desc()], act=ordered.latest(act), **sizes)
    total = F.col("minutes").cast("bigint") * (60 * MICROS_PER_SECOND)
    seen = seen.filter(F.col("kind").isNull()).select("user_id", "pos", "at", total.alias("total"), "act")
    seen = seen.withColumn("meets", F.coalesce(F.col("act.at") < F.col("at") + F.col("total"), F.lit(False)))
    seen = durable(seen, "starts")
    columns = ("user_id", "pos", "at", "total")
    none = F.lit(None).cast("bigint")
    alone = seen.filter(~F.col("meets")).select(
        *columns, (F.col("at") + F.col("total")).alias("ended"), F.lit(0).cast("bigint").alias("left"),
        F.lit("completed").alias("outcome"), none.alias("closed"))
    stopped = seen.filter(F.col("meets") & (F.col("act.kind") == "stop")).select(
        *columns, F.col("act.at").alias("ended"), (F.col("at") + F.col("total") - F.col("act.at")).alias("left"),
        F.lit("stopped").alias("outcome"), F.col("act.pos").alias("closed"))
    paused = seen.filter(F.col("meets") & (F.col("act.kind") == "toggle"))
    return durable(alone.unionByName(stopped).unionByName(_paused(paused, acts, columns, **sizes)), "ends")


def _paused(starts: DataFrame, acts: DataFrame, columns: tuple[str, ...], **sizes: int) -> DataFrame:
    """Ends of starts whose first event is a pause: the time they run lies between toggles of the other parity."""
    act = F.col("act")
    need = F.col("at") + F.col("total") - act["at"]
    parity = (act["number"] + 1) % 2
    asked = starts.select(
        *columns, "act", parity.alias("parity"), need.alias("need"), (_of_parity(act, parity) + need).alias("upto"),
        F.lit(None).cast("struct<pos:bigint,then:bigint,upto:bigint>").alias("gap"))
    upto = _of_parity(F.struct("even", "odd"), F.col("number") % 2)
    gaps = acts.select("user_id", "pos", (F.col("number") % 2).alias("parity"), upto.alias("upto"), "then")
    gaps = gaps.select("user_id", "pos", "parity", "upto", F.struct("pos", "then", "upto").alias("gap"))
    # The first gap, in time, that brings the sum up to what is asked stands just before the question.
    order = [F.col("upto").desc(), F.col("gap").isNull().cast("int"), F.col("pos").desc()]
    both = _kept(asked.unionByName(gaps, allowMissingColumns=True), "pauses", **sizes)
    found = ordered.scan(both, ["user_id", "parity"], order, full=ordered.latest(F.col("gap")), **sizes).filter(F.col("gap").isNull())
    halt, last, full = F.col("act.halt"), F.col("act.last"), F.col("full")
    runs_out = full.isNotNull() & (halt.isNull() | (full["pos"] < halt["pos"]))
    before = F.col("upto") - F.col("need")
    at_halt = F.col("need") - (_of_parity(halt, F.col("parity")) - before)
    at_last = F.col("need") - (_of_parity(last, F.col("parity")) - before)
    goes_on = F.col("act.number") % 2 == 0  # as many resumes as pauses
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    return found.select(
        *columns,
        F.when(runs_out, full["then"] - (full["upto"] - F.col("upto"))).when(halt.isNotNull(), halt["at"])
        .when(goes_on, last["at"] + at_last).otherwise(none).alias("ended"),
        F.when(runs_out, zero).when(halt.isNotNull(), at_halt).when(goes_on, zero).otherwise(at_last).alias("left"),
        F.when(runs_out, "completed").when(halt.isNotNull(), "stopped").when(goes_on, "completed").otherwise("open").alias("outcome"),
        F.when(~runs_out, halt["pos"]).otherwise(none).alias("closed"),
    )


def followers(ended: DataFrame, **sizes: int) -> DataFrame:
    """(user_id, start, next): the first start that could be accepted after each, null if there is none.

    ``ended`` has its starts numbered in order, without gaps, as ``start``.
    """
    none = F.lit(None).cast("bigint")
    starts = ended.select("user_id", F.col("at").alias("time"), F.col("pos").alias("place"), none.alias("start"), F.col("start").alias("next"))
    # An end by itself lets in starts at the same moment; a stop those after it.
    asks = ended.filter("ended is not null").select(
        "user_id", F.col("ended").alias("time"), F.coalesce("closed", F.lit(-1).cast("bigint")).alias("place"), "start", none.alias("next"))
    both = _kept(starts.unionByName(asks), "followers", **sizes)
    order = [F.col("time").desc(), F.col("place").desc(), F.col("start").desc()]
    found = ordered.scan(both, ["user_id"], order, first=ordered.latest(F.col("next")), **sizes).filter("start is not null")
    lone = ended.filter("ended is null").select("user_id", "start", none.alias("next"))
    return found.select("user_id", "start", F.col("first").alias("next")).unionByName(lone)


def accepted(starts: DataFrame, chunk_starts: int = CHUNK_STARTS) -> DataFrame:
    """(start): the starts that each user's first one leads to, from a stored table (user_id, start, next) of all.

    A turn doubles the pointers between chunks: a log of c chunks takes at most
    log2(c) + 1 turns.
    """
    firsts = durable(starts.groupBy("user_id").agg(F.min("start").alias("start")).select("start"), "firsts")
    part = F.expr(f"start div {chunk_starts}").alias("part")
    chunks = durable(starts.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("start", "next"))).alias("s")), "start-chunks")
    # From the last start back: where each leaves the chunk.
    size, base = F.size("s"), F.col("part") * chunk_starts

    def leaves(done: Column, x: Column) -> Column:
        there = F.coalesce((x["next"] - base).cast("int"), size)
        return F.array_append(done, F.when(there < size, F.get(done, size - 1 - there)).otherwise(x["start"]))

    exits = F.reverse(F.aggregate(F.reverse("s"), F.array().cast("array<bigint>"), leaves))
    each = chunks.withColumn("exits", exits).select(F.explode(F.zip_with(
        "s", "exits", lambda x, e: F.struct(x["start"].alias("start"), x["next"].alias("next"), e.alias("exit")))).alias("x")).select("x.*")
    each = durable(each, "exits")
    out = each.select(F.col("start").alias("next"), F.col("exit").alias("to"))
    jumps = each.filter("exit = start and next is not null").join(out, "next").select("start", "to")
    # Rows with ``to`` are pointers of this turn's length, the others starts that chains have led to.
    met = each.join(firsts, "start", "left_semi").select(F.col("exit").alias("start"), F.lit(None).cast("bigint").alias("to"))
    state = durable(jumps.unionByName(met), "chains")
    while not state.filter("to is not null").isEmpty():
        jumps, met = state.filter("to is not null"), state.filter("to is null")
        on = jumps.select(F.col("start").alias("to"), F.col("to").alias("further"))
        twice = jumps.join(on, "to").select("start", F.col("further").alias("to"))
        led = met.select("start").join(jumps, "start").select(F.col("to").alias("start"), F.lit(None).cast("bigint").alias("to"))
        state = durable(met.unionByName(led).unionByName(twice), "chains")
    entered = each.join(state.select("start"), "start", "left_semi").filter("next is not null").select(F.col("next").alias("start"))
    entering = entered.unionByName(firsts).groupBy(part).agg(F.collect_set("start").alias("entries"))
    begun = F.struct(F.array().cast("array<bigint>").alias("taken"), F.lit(None).cast("bigint").alias("want"))

    def takes(state: Column, x: Column) -> Column:
        hit = F.coalesce(x["start"] == state["want"], F.lit(False)) | F.array_contains("entries", x["start"])
        return F.struct(
            F.when(hit, F.array_append(state["taken"], x["start"])).otherwise(state["taken"]).alias("taken"),
            F.when(hit, x["next"]).otherwise(state["want"]).alias("want"),
        )

    return chunks.join(entering, "part").select(F.explode(F.aggregate("s", begun, takes, lambda a: a["taken"])).alias("start"))


def sessions_in(
    log: DataFrame, rows: int = ordered.CHUNK_ROWS, chunk_starts: int = CHUNK_STARTS, limit: int = ordered.PLAIN_LIMIT
) -> DataFrame:
    """(user_id, event_id, task_id, is_break, planned_minutes, at, ended, left, outcome) of all accepted starts."""
    events = log.select("user_id", "ts", "event_id", micros(F.col("ts")).alias("at"), "kind",
                        F.col("planned_minutes").alias("minutes"), "is_break", "task_id")
    placed = ordered.chunked(events, ["user_id"], ["ts", "event_id"], rows).withColumnRenamed("_pos", "pos").drop("_chunk")
    many = not ordered.large_keys(placed, ["user_id"], limit).isEmpty()
    sizes = {"limit": limit, "chunk_rows": max(1, limit)} if many else {"limit": None}
    ended = ends(placed.select("user_id", "pos", "at", "kind", "minutes"), **sizes)
    ended = durable(ordered.number(ended, ["pos"], "start"), "numbered-starts")
    taken = accepted(durable(followers(ended, **sizes), "pointers"), chunk_starts)
    facts = placed.select("pos", "event_id", "task_id", "is_break", F.col("minutes").alias("planned_minutes"))
    return ended.join(taken, "start", "left_semi").join(facts, "pos")
