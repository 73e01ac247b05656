"""Score bands and reading codes. Boundary cases differ by measure on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.catalogue import (
    ACCURACY_CUTS, ANXIETY_HIGH, ANXIETY_LOW, BDEFS, BDEFS_DOMAINS, BIS, BISBAS, BISBAS_DOMAINS,
    DRIVE, FUN, QUARTERS, REWARD, SPEED_CUTS, TRAIT_HIGH, TRAIT_LOW, WHOLE_HIGH, WHOLE_LOW,
    domain_floor, domain_max, total_floor, total_max,
)
from cairn.functions.columns import percent, present, score_of


def quarter_band(pct: Column, top: str) -> Column:
    """Four bands cut at the quarters, upper bounds included."""
    low, middle, high = QUARTERS
    return (
        F.when(pct <= low, "minimal")
        .when(pct <= middle, "mild")
        .when(pct <= high, "moderate")
        .otherwise(top)
    )


def bdefs_band(score: Column, max_score: Column) -> Column:
    """Overall difficulty band of an executive-function total."""
    return quarter_band(percent(score, max_score), "significant")


def domain_band(domain: Column, score: Column, max_domain: Column) -> Column:
    """Difficulty band of one executive-function domain, null for an unknown one."""
    band = quarter_band(percent(score, max_domain), "high")
    return F.when(domain.isin(*BDEFS_DOMAINS), band)


def bisbas_total(score: Column) -> Column:
    """Motivation total with the questionnaire floor taken off."""
    return F.greatest(score - total_floor(BISBAS), F.lit(0))


def bisbas_total_range() -> int:
    """Range of :func:`bisbas_total`."""
    return total_max(BISBAS) - total_floor(BISBAS)


def bisbas_domain_score(domain: Column, score: Column) -> Column:
    """Motivation domain score without its floor; an unknown domain has floor 0."""
    floor = F.when(domain.isin(*BISBAS_DOMAINS), domain_floor(BISBAS)).otherwise(0)
    return F.greatest(score - floor, F.lit(0))


def bisbas_domain_range(domain: Column) -> Column:
    """Range of :func:`bisbas_domain_score`, 0 for an unknown domain."""
    known = domain_max(BISBAS) - domain_floor(BISBAS)
    return F.when(domain.isin(*BISBAS_DOMAINS), known).otherwise(0)


def bisbas_domain_band(domain: Column, score: Column) -> Column:
    """Low, moderate or high on the floor-free percentage, null for an unknown domain."""
    pct = percent(bisbas_domain_score(domain, score), bisbas_domain_range(domain))
    band = F.when(pct <= TRAIT_LOW, "low").when(pct <= TRAIT_HIGH, "moderate").otherwise("high")
    return F.when(domain.isin(*BISBAS_DOMAINS), band)


def advice_band(kind: Column, domain: Column, score: Column) -> Column:
    """The band advice is looked up by, for both questionnaires."""
    return F.when(
        kind == BDEFS, domain_band(domain, score, F.lit(domain_max(BDEFS)))
    ).when(kind == BISBAS, bisbas_domain_band(domain, score))


def floor_free_pct(scores: Column, domain: str) -> Column:
    """Floor-free percentage of one motivation domain out of a score map."""
    name = F.lit(domain)
    return percent(
        bisbas_domain_score(name, score_of(scores, domain)), bisbas_domain_range(name)
    )


def bisbas_profile_codes(score: Column, scores: Column) -> Column:
    """Reading codes of a motivation result, in reading order."""
    bis, drive = floor_free_pct(scores, BIS), floor_free_pct(scores, DRIVE)
    reward, fun = floor_free_pct(scores, REWARD), floor_free_pct(scores, FUN)
    whole = percent(bisbas_total(score), F.lit(bisbas_total_range()))
    return present(
        [
            F.when(bis >= ANXIETY_HIGH, "bis_high").when(bis <= ANXIETY_LOW, "bis_low_to_moderate").otherwise(
                "bis_moderate"
            ),
            F.when(drive >= TRAIT_HIGH, "drive_strong").when(drive <= TRAIT_LOW, "drive_low").otherwise(
                "drive_moderate"
            ),
            F.when(reward >= TRAIT_HIGH, "reward_strong").when(reward <= TRAIT_LOW, "reward_weak"),
            F.when(fun >= TRAIT_HIGH, "fun_strong").when(fun <= TRAIT_LOW, "fun_weak"),
            F.when(whole <= WHOLE_LOW, "overall_low").when(whole >= WHOLE_HIGH, "overall_high").otherwise(
                "overall_moderate"
            ),
        ]
    )


def bisbas_tip_codes(scores: Column) -> Column:
    """Tip codes of a motivation result; a middling drive has none."""
    bis, drive = floor_free_pct(scores, BIS), floor_free_pct(scores, DRIVE)
    reward, fun = floor_free_pct(scores, REWARD), floor_free_pct(scores, FUN)
    return present(
        [
            F.when(bis >= ANXIETY_HIGH, "bis_high").when(bis <= ANXIETY_LOW, "bis_low").otherwise("bis_middle"),
            F.when(drive <= TRAIT_LOW, "drive_low").when(drive >= TRAIT_HIGH, "drive_high"),
            F.when(reward >= TRAIT_HIGH, "reward_high").otherwise("reward_other"),
            F.when(fun >= TRAIT_HIGH, "fun_high").otherwise("fun_other"),
        ]
    )


def stroop_accuracy_code(correct: Column, trials: Column) -> Column:
    """Accuracy code of a reaction test."""
    pct = percent(correct, trials)
    return (
        F.when(pct >= ACCURACY_CUTS["excellent"], "excellent")
        .when(pct >= ACCURACY_CUTS["good"], "good")
        .when(pct >= ACCURACY_CUTS["moderate"], "moderate")
        .otherwise("low")
    )


def stroop_speed_code(avg_ms: Column) -> Column:
    """Speed code of a reaction test."""
    return F.when(avg_ms <= SPEED_CUTS["fast"], "fast").when(avg_ms <= SPEED_CUTS["average"], "average").otherwise("slow")


def clamp(value: Column, low: int, high: int) -> Column:
    """The value moved into ``low..high``."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
