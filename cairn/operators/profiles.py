"""Rule-based personalisation per user, from the latest results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import catalogue
from cairn.catalogue import AVG_TIME_KEY, BDEFS, BIS, BISBAS, DRIVE, FUN, REWARD, STROOP, domain_max
from cairn.functions.bands import clamp
from cairn.functions.columns import percent, score_of

# The profile of a user without results.
DEFAULTS = {
    "focus_minutes": 15,
    "break_minutes": 5,
    "nudge_style": "balanced",
    "suggest_breakdown": False,
    "encourage_reward": False,
    "add_reassurance": False,
}
FIELDS = list(DEFAULTS)


def latest_three_types(results: DataFrame) -> DataFrame:
    """Newest result of each type in one row per user: one aggregation, no join.

    Equal times go to the higher id.
    """
    row = F.struct("taken_at", "id", "score", "max_score", "domain_scores")
    order = F.struct("taken_at", "id")
    picks = [
        F.max_by(row, F.when(F.col("type") == kind, order)).alias(kind)
        for kind in (BDEFS, STROOP, BISBAS)
    ]
    return results.groupBy("user_id").agg(*picks)


def with_bisbas_profile(rows: DataFrame, scores: Column) -> DataFrame:
    """Add the profile fields from motivation scores; null scores give the defaults.

    Works on raw percentages; a missing domain counts as 0.
    """
    whole = F.lit(domain_max(BISBAS))
    pct = {d: percent(score_of(scores, d), whole) for d in (BIS, DRIVE, REWARD, FUN)}
    known = scores.isNotNull()
    flags = rows.withColumns(
        {
            "_anxious": known & (pct[BIS] >= catalogue.ANXIETY_HIGH),
            "_slack": known & (pct[DRIVE] <= catalogue.TRAIT_LOW),
            "_keen": known & (pct[DRIVE] >= catalogue.TRAIT_HIGH),
            "_rewarded": known & (pct[REWARD] >= catalogue.TRAIT_HIGH),
            "_playful": known & (pct[FUN] >= catalogue.TRAIT_HIGH),
        }
    )
    careful = F.col("_anxious") | F.col("_slack")
    eager = F.col("_keen") & F.col("_rewarded")
    focus = F.when(careful, catalogue.FOCUS_CAREFUL).when(eager, catalogue.FOCUS_EAGER).otherwise(DEFAULTS["focus_minutes"])
    rest = F.when(careful, catalogue.BREAK_LONG).otherwise(DEFAULTS["break_minutes"])
    liked = F.col("_rewarded") | F.col("_keen")
    style = (
        F.when(F.col("_anxious"), "reassuring")
        .when(liked, "reward")
        .otherwise(DEFAULTS["nudge_style"])
    )
    playful = F.col("_playful")
    return flags.withColumns(
        {
            "focus_minutes": F.when(playful, F.least(focus, F.lit(catalogue.FOCUS_SHORT))).otherwise(focus),
            "break_minutes": F.when(playful, F.greatest(rest, F.lit(catalogue.BREAK_LONG))).otherwise(rest),
            "nudge_style": style,
            "suggest_breakdown": careful,
            "encourage_reward": liked,
            "add_reassurance": F.col("_anxious"),
        }
    ).drop("_anxious", "_slack", "_keen", "_rewarded", "_playful")


def _with_bdefs(rows: DataFrame) -> DataFrame:
    pct = F.col("_difficulty")
    severe, little = pct >= catalogue.DIFFICULTY_SEVERE, pct <= catalogue.DIFFICULTY_LITTLE
    some = (pct >= catalogue.DIFFICULTY_SOME) & ~severe
    hard = severe | some

    def when(cond: Column, then: Column, name: str) -> Column:
        return F.when(cond, then).otherwise(F.col(name))

    focus, rest, yes = F.col("focus_minutes"), F.col("break_minutes"), F.lit(True)
    return rows.withColumns(
        {
            "focus_minutes": F.when(severe, focus - 3).when(some, focus - 2).when(little, focus + 2).otherwise(focus),
            "break_minutes": F.when(severe, rest + 2).when(some, rest + 1).otherwise(rest),
            "nudge_style": when(severe, F.lit("reassuring"), "nudge_style"),
            "suggest_breakdown": when(hard, yes, "suggest_breakdown"),
            "encourage_reward": when(little, yes, "encourage_reward"),
            "add_reassurance": when(severe, yes, "add_reassurance"),
        }
    )


def _with_stroop(rows: DataFrame) -> DataFrame:
    accuracy, ms = F.col("_accuracy"), F.col("_avg_ms")
    weak = (accuracy < catalogue.WEAK_ACCURACY) | (ms >= catalogue.WEAK_MS)
    sharp = ~weak & (accuracy >= catalogue.SHARP_ACCURACY) & (ms > 0) & (ms <= catalogue.SHARP_MS)
    focus, rest, style = F.col("focus_minutes"), F.col("break_minutes"), F.col("nudge_style")
    yes = F.lit(True)
    return rows.withColumns(
        {
            "focus_minutes": F.when(weak, F.least(focus, F.lit(catalogue.FOCUS_SHORT))).when(sharp, focus + 2).otherwise(focus),
            "break_minutes": F.when(weak, F.greatest(rest, F.lit(catalogue.BREAK_LONG)))
            .when(sharp, F.greatest(rest - 1, F.lit(catalogue.BREAK_LEAST))).otherwise(rest),
            "nudge_style": F.when(weak & (style != "reward"), "reassuring")
            .when(sharp & (style != "reassuring"), "reward").otherwise(style),
            "suggest_breakdown": F.when(weak, yes).otherwise(F.col("suggest_breakdown")),
            "encourage_reward": F.when(sharp, yes).otherwise(F.col("encourage_reward")),
            "add_reassurance": F.when(weak, yes).otherwise(F.col("add_reassurance")),
        }
    )


def profile_bisbas(results: DataFrame) -> DataFrame:
    """The profile each single motivation result would give."""
    own = results.filter(F.col("type") == BISBAS)
    return with_bisbas_profile(own, F.col("domain_scores")).select("id", "user_id", *FIELDS)


def profile_latest_bisbas(latest: DataFrame) -> DataFrame:
    """Profile per user from the newest motivation result, defaults without one.

    ``latest`` comes from :func:`latest_three_types`.
    """
    return with_bisbas_profile(latest, F.col(f"{BISBAS}.domain_scores")).select("user_id", *FIELDS)


def profile_blended(latest: DataFrame) -> DataFrame:
    """Profile per user from the newest result of all three types."""

    def share(kind: str) -> Column:
        # No result, or one without a scale, has no say: the percentage stays null.
        score, whole = F.col(f"{kind}.score"), F.col(f"{kind}.max_score")
        return F.when(whole > 0, score / whole * 100)

    base = with_bisbas_profile(latest, F.col(f"{BISBAS}.domain_scores")).withColumns(
        {
            "_difficulty": share(BDEFS),
            "_accuracy": share(STROOP),
            "_avg_ms": F.when(
                F.col(f"{STROOP}.max_score") > 0,
                score_of(F.col(f"{STROOP}.domain_scores"), AVG_TIME_KEY),
            ),
        }
    )
    blended = _with_stroop(_with_bdefs(base))
    return blended.select(
        "user_id",
        clamp(F.col("focus_minutes"), 8, 25).alias("focus_minutes"),
        clamp(F.col("break_minutes"), 4, 12).alias("break_minutes"),
        *FIELDS[2:],
    )


def nudge_text(style: Column, message: Column, prefixes: dict[str, str]) -> Column:
    """The message behind the prefix of the style, if the caller gives one."""
    text = message
    for name, prefix in prefixes.items():
        text = F.when(style == name, F.concat(F.lit(prefix), F.lit(" "), message)).otherwise(text)
    return text


def act_gate() -> Column:
    """Whether journal prompts are offered."""
    return F.col("suggest_breakdown") | F.col("add_reassurance")


def act_guidance_code() -> Column:
    """Which guidance goes with the journal prompts."""
    split, calm = F.col("suggest_breakdown"), F.col("add_reassurance")
    return (
        F.when(calm & split, "both")
        .when(calm, "reassurance")
        .when(split, "breakdown")
        .otherwise("neither")
    )
