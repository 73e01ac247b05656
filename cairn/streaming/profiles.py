"""Profiles that follow newly saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairn.operators import profiles


def stream_latest_results(results: DataFrame) -> DataFrame:
    """Newest result of each type per user, sent again whenever one is saved.

    State is one row per user: the newest three results, not their history.
    """
    return profiles.latest_three_types(results)


def stream_latest_profile(results: DataFrame) -> DataFrame:
    """The blended profile per user, in update mode."""
    return profiles.profile_blended(stream_latest_results(results))
