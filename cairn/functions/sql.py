"""The bands as SQL functions, for people who write Spark SQL."""

from pyspark.sql import SparkSession

_QUARTERS = "CASE WHEN {p} <= 25 THEN 'minimal' WHEN {p} <= 50 THEN 'mild' WHEN {p} <= 75 THEN 'moderate' ELSE '{top}' END"
_PCT = "CASE WHEN {b} <> 0 THEN {a} / {b} * 100 ELSE 0D END"

DEFINITIONS = {
    "cairn_percent(part BIGINT, whole BIGINT)": (
        "DOUBLE", _PCT.format(a="part", b="whole")
    ),
    "cairn_bdefs_band(score BIGINT, max_score BIGINT)": (
        "STRING", _QUARTERS.format(p="cairn_percent(score, max_score)", top="significant")
    ),
    "cairn_domain_band(score BIGINT, max_score BIGINT)": (
        "STRING", _QUARTERS.format(p="cairn_percent(score, max_score)", top="high")
    ),
    "cairn_stroop_accuracy(correct BIGINT, trials BIGINT)": (
        "STRING",
        "CASE WHEN cairn_percent(correct, trials) >= 90 THEN 'excellent' "
        "WHEN cairn_percent(correct, trials) >= 70 THEN 'good' "
        "WHEN cairn_percent(correct, trials) >= 50 THEN 'moderate' ELSE 'low' END",
    ),
    "cairn_stroop_speed(avg_ms BIGINT)": (
        "STRING",
        "CASE WHEN avg_ms <= 1000 THEN 'fast' WHEN avg_ms <= 2000 THEN 'average' ELSE 'slow' END",
    ),
    "cairn_clamp(value BIGINT, low BIGINT, high BIGINT)": (
        "BIGINT", "least(greatest(value, low), high)"
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for head, (kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in DEFINITIONS]
