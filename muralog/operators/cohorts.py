"""Placements of a chosen set of users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from muralog.sources.scratch import sized


def placements_of(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of `df` by the users in `users`; an empty set gives no rows.

    A cohort grows with the data, so it is joined rather than listed in the query,
    and its size is known before the placements are touched. Taking its distinct ids lets the
    planner drop any order the users came in.
    """
    return df.join(sized(users.select("user_id").distinct(), "cohort"), "user_id", "left_semi")
