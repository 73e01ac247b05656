"""Past results: newest first, newest against the one before, readable entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.catalogue import (
    AVG_TIME_KEY, BANDS, BDEFS, BDEFS_DOMAINS, BISBAS, BISBAS_DOMAINS, DOMAINS, STROOP,
    domain_max,
)
from cairn.functions.bands import (
    advice_band, bdefs_band, bisbas_domain_range, bisbas_domain_score, bisbas_profile_codes,
    bisbas_total, bisbas_total_range, stroop_accuracy_code, stroop_speed_code,
)
from cairn.functions.columns import percent, score_of
from cairn.operators import ordered
from cairn.session import durable


def newest(rows: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key, with their rank.

    The limit is cut per key already before the shuffle, so at most ``n`` rows
    of a key leave each input task, however large the key is.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recent_assessments(results: DataFrame, n: int = 20, kind: str | None = None) -> DataFrame:
    """Newest results per user, of one type or of all."""
    if kind is not None:
        results = results.filter(F.col("type") == kind)
    return newest(results, ["user_id"], "taken_at", n)


def recent_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """Newest focus sessions per user."""
    return newest(sessions, ["user_id"], "completed_at", n)


def recent_journal(entries: DataFrame, n: int = 20) -> DataFrame:
    """Newest journal entries per user."""
    return newest(entries, ["user_id"], "created_at", n)


def latest_per_type(results: DataFrame) -> DataFrame:
    """Newest result per user and type."""
    return newest(results, ["user_id", "type"], "taken_at", 1).drop("rank")


def latest_vs_previous(results: DataFrame) -> DataFrame:
    """Newest result per user and type beside the one before it, null if there is none."""
    two = newest(results, ["user_id", "type"], "taken_at", 2)
    row = F.struct("id", "taken_at", "score", "max_score", "domain_scores")
    return two.groupBy("user_id", "type").agg(
        F.max_by(row, F.when(F.col("rank") == 1, 1)).alias("latest"),
        F.max_by(row, F.when(F.col("rank") == 2, 1)).alias("previous"),
    )


def count_results(results: DataFrame) -> DataFrame:
    """Number of saved results per user, not capped."""
    return results.groupBy("user_id").agg(F.count(F.lit(1)).alias("results"))


def band_distribution(results: DataFrame) -> DataFrame:
    """Users per band and domain, by their newest result of each type."""
    newest_ones = latest_per_type(results.filter(F.col("type").isin(BDEFS, BISBAS)))
    domains = newest_ones.select("type", F.explode("domain_scores").alias("domain", "score"))
    band = advice_band(F.col("type"), F.col("domain"), F.col("score"))
    return domains.withColumn("band", band).groupBy("type", "domain", "band").agg(
        F.count(F.lit(1)).alias("users")
    )


# --- advice ------------------------------------------------------------------


def _known_advice(advice: DataFrame) -> DataFrame:
    """The caller's advice for bands that exist, one text each: 32 rows at most."""
    known = F.lit(False)
    for kind, names in DOMAINS.items():
        known = known | (
            (F.col("type") == kind) & F.col("domain").isin(*names) & F.col("band").isin(*BANDS[kind])
        )
    return advice.filter(known).groupBy("type", "domain", "band").agg(F.min("text").alias("text"))


def advice_lookup(domain_rows: DataFrame, advice: DataFrame) -> DataFrame:
    """Band and advice text per domain score; an unknown domain gets an empty text.

    Broadcasting is safe: whatever the caller passes, the lookup is reduced to
    the catalogue's bands first. A shuffle on so few keys could not spread.
    """
    band = advice_band(F.col("type"), F.col("domain"), F.col("domain_score"))
    return (
        domain_rows.withColumn("band", band)
        .join(F.broadcast(_known_advice(advice)), ["type", "domain", "band"], "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
    )


def advice_lookup_range(domain_rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Bands held as rows ``(type, domain, lo, hi, band)``: the band with ``lo < pct <= hi``.

    A percentage of 0 belongs to the lowest band, whose ``lo`` is below 0.
    Ranges of one domain do not overlap. They are written down first: from the
    known size the planner broadcasts them, and joins on type and domain if it
    should not.
    """
    floor_free = bisbas_domain_score(F.col("domain"), F.col("domain_score"))
    pct = F.when(
        F.col("type") == BDEFS, percent(F.col("domain_score"), F.lit(domain_max(BDEFS)))
    ).otherwise(percent(floor_free, bisbas_domain_range(F.col("domain"))))
    rows = domain_rows.withColumn("pct", pct).alias("r")
    cut = durable(cuts, "cuts").alias("c")
    inside = (
        (F.col("r.type") == F.col("c.type"))
        & (F.col("r.domain") == F.col("c.domain"))
        & (F.col("r.pct") > F.col("c.lo"))
        & (F.col("r.pct") <= F.col("c.hi"))
    )
    return rows.join(cut, inside, "left").select("r.*", "c.band")


# --- readable entries ----------------------------------------------------------


def history_entries(results: DataFrame, n: int = 10, kind: str | None = None) -> DataFrame:
    """The newest ``n`` results per user as typed lines: no wording, only numbers and codes.

    ``lines`` holds structs of ``part`` (``total``, ``domain``, ``time`` or
    ``reading``), ``name`` (a domain), ``value``, ``out_of`` and ``code`` (a band
    or reading); what does not apply is null. A missing score map counts as an
    empty one: the total and the readings stay. :func:`worded` puts a caller's
    labels to the lines.
    """
    rows = recent_assessments(results, n, kind)
    score, whole = F.col("score"), F.col("max_score")
    scores = F.coalesce("domain_scores", F.create_map().cast("map<string,int>"))
    own = F.col("type")
    is_bdefs, is_bisbas, is_stroop = (own == k for k in (BDEFS, BISBAS, STROOP))
    none = F.lit(None)

    def line(part: str, name=none, value=none, out_of=none, code=none) -> Column:
        return F.struct(
            F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("int").alias("value"),
            out_of.cast("int").alias("out_of"), code.cast("string").alias("code"),
        )

    total = F.when(is_bisbas, line("total", none, bisbas_total(score), F.lit(bisbas_total_range()))).otherwise(
        line("total", none, score, whole)
    )

    def domain(entry: Column) -> Column:
        name, value = entry["key"], entry["value"]
        floor_free = line(
            "domain", name, bisbas_domain_score(name, value),
            F.greatest(bisbas_domain_range(name), F.lit(1)), advice_band(F.lit(BISBAS), name, value),
        )
        return F.when(is_bisbas, floor_free).otherwise(
            line("domain", name, value, none, advice_band(F.lit(BDEFS), name, value))
        )

    time = score_of(scores, AVG_TIME_KEY)
    no_lines = F.array().cast("array<struct<part:string,name:string,value:int,out_of:int,code:string>>")
    middle = F.when(is_bdefs | is_bisbas, F.transform(F.map_entries(scores), domain)).when(
        is_stroop, F.array(line("time", none, time))
    ).otherwise(no_lines)
    codes = (
        F.when(is_bdefs, F.array(bdefs_band(score, whole)))
        .when(is_bisbas, bisbas_profile_codes(score, scores))
        .when(is_stroop, F.array(stroop_accuracy_code(score, whole), stroop_speed_code(time)))
    )
    readings = F.transform(
        F.coalesce(F.array_compact(codes), F.array().cast("array<string>")), lambda c: line("reading", none, none, none, c)
    )
    return rows.select(
        "user_id", "id", "rank", "type", "taken_at", F.concat(F.array(total), middle, readings).alias("lines")
    )


def worded(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per line with the caller's ``label`` for its ``part`` and ``code``, null where there is none.

    ``labels`` is (part, code, label); a null code labels all lines of a part
    that have no label for theirs. The table is written first, so the planner
    knows its size and decides how to join.
    """
    known = durable(labels.select("part", "code", "label"), "labels")
    lines = entries.select("*", F.posexplode("lines").alias("line_no", "line")).drop("lines")
    lines = lines.select(*[c for c in lines.columns if c != "line"], "line.*").alias("l")
    exact = known.filter(F.col("code").isNotNull()).select("part", "code", "label").alias("x")
    plain = known.filter(F.col("code").isNull()).select("part", "label").alias("p")
    found = lines.join(
        exact, (F.col("l.part") == F.col("x.part")) & (F.col("l.code") == F.col("x.code")), "left"
    ).join(plain, F.col("l.part") == F.col("p.part"), "left")
    return found.select("l.*", F.coalesce("x.label", "p.label").alias("label"))


# --- chart data ----------------------------------------------------------------


def in_order(scores: Column, domains: tuple[str, ...]) -> Column:
    """Scores as an array in display order, 0 when missing."""
    return F.array(*[score_of(scores, d).cast("double") for d in domains])


def radar_vector(scores: Column) -> Column:
    """The five executive-function scores."""
    return in_order(scores, BDEFS_DOMAINS)


def bisbas_bars(scores: Column) -> Column:
    """The four motivation scores without their floor, out of 15."""
    return F.array(
        *[bisbas_domain_score(F.lit(d), score_of(scores, d)) for d in BISBAS_DOMAINS]
    )


def reserve_pct(scores: Column) -> Column:
    """Headroom per executive-function domain in percent, never negative."""
    whole = domain_max(BDEFS)
    return F.transform(
        radar_vector(scores), lambda raw: F.greatest(whole - raw, F.lit(0.0)) / whole * 100
    )


def reserve_delta(pairs: DataFrame) -> DataFrame:
    """Newest reserve per domain against the result before.

    ``pairs`` comes from :func:`latest_vs_previous`. Changes within 0.9 points
    are steady; shown numbers round half to even.
    """
    own = pairs.filter(F.col("type") == BDEFS)
    now, then = F.col("now"), F.col("then")
    rows = own.select(
        "user_id",
        F.col("latest.id").alias("id"),
        F.posexplode(
            F.arrays_zip(
                reserve_pct(F.col("latest.domain_scores")).alias("now"),
                # An array of nulls, not a null array: zipping with that loses the row.
                F.when(
                    F.col("previous").isNotNull(), reserve_pct(F.col("previous.domain_scores"))
                ).otherwise(
                    F.array_repeat(F.lit(None).cast("double"), len(BDEFS_DOMAINS))
                ).alias("then"),
            )
        ).alias("place", "r"),
    ).select("user_id", "id", "place", F.col("r.now").alias("now"), F.col("r.then").alias("then"))
    delta = now - then
    return rows.withColumns(
        {
            "domain": F.element_at(
                F.array(*[F.lit(d) for d in BDEFS_DOMAINS]), F.col("place") + 1
            ),
            "direction": F.when(then.isNull(), "only")
            .when(delta > 0.9, "up").when(delta < -0.9, "down").otherwise("steady"),
            "shown": F.when(then.isNull(), F.bround(now, 0))
            .when(F.abs(delta) > 0.9, F.bround(delta, 0)),
        }
    )


def reserve_overall(pairs: DataFrame) -> DataFrame:
    """Overall reserve (not floored) and its direction of change, if at least one point."""
    own = pairs.filter(F.col("type") == BDEFS)

    def overall(side: str) -> Column:
        score, whole = F.col(f"{side}.score"), F.col(f"{side}.max_score")
        return percent(whole - score, whole)

    then = F.when(F.col("previous.max_score") > 0, overall("previous"))
    return own.select(
        "user_id", F.col("latest.id").alias("id"),
        overall("latest").alias("reserve"), then.alias("reserve_before"),
    ).withColumn("delta", F.col("reserve") - F.col("reserve_before")).withColumn(
        "direction",
        F.when(F.abs("delta") >= 1, F.when(F.col("delta") > 0, "up").otherwise("down")),
    )


# --- profile in force ------------------------------------------------------------


def assessment_asof_session(
    sessions: DataFrame, results: DataFrame, kind: str = BISBAS, **sizes: int
) -> DataFrame:
    """Each focus session with the newest result at or before its end, if any."""
    taken = results.filter(F.col("type") == kind).select(
        "user_id", F.col("taken_at").alias("at"), F.lit(0).alias("side"), "id",
        F.struct("id", "taken_at", "score", "domain_scores").alias("result"),
    )
    ended = sessions.select(
        "user_id", F.col("completed_at").alias("at"), F.lit(1).alias("side"), "id",
        F.lit(None).cast(taken.schema["result"].dataType).alias("result"),
    )
    known = ordered.scan(
        taken.unionByName(ended), ["user_id"], ["at", "side", "id"],
        in_force=ordered.latest(F.col("result")), **sizes,
    )
    return known.filter(F.col("side") == 1).select(
        "user_id", "id", F.col("at").alias("completed_at"),
        F.col("in_force.id").alias("result_id"),
        F.col("in_force.taken_at").alias("result_taken_at"),
        F.col("in_force.score").alias("result_score"),
        F.col("in_force.domain_scores").alias("domain_scores"),
    )
