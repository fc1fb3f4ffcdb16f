"""Activity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.sources.placements import between, during


def activity_per_minute(df: DataFrame, unit: str = "minute") -> DataFrame:
    """`minute, placements` in time order; a unit without placements has no row."""
    return _per_unit(df, unit).orderBy("minute")


def top_minutes(df: DataFrame, n: int = 10, unit: str = "minute") -> DataFrame:
    """The n busiest units, busiest first."""
    return _per_unit(df, unit).orderBy(F.desc("placements"), "minute").limit(n)


def activity_in_range(df: DataFrame, low, high, unit: str = "minute") -> DataFrame:
    """As `activity_per_minute`, for instants from `low` to `high` with both ends in."""
    return activity_per_minute(between(df, low, high), unit)


def minute_heatmap(df: DataFrame, minute, unit: str = "minute") -> DataFrame:
    """`x, y, edits` within one unit of time."""
    return (
        during(df, unit, minute)
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("edits"))
    )


def active_users_per_minute(df: DataFrame, unit: str = "minute") -> DataFrame:
    """`minute, active_users` (distinct), most active first."""
    return (
        df.groupBy(F.date_trunc(unit, "ts").alias("minute"))
        .agg(F.countDistinct("user_id").alias("active_users"))
        .orderBy(F.desc("active_users"), "minute")
    )


def _per_unit(df: DataFrame, unit: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, "ts").alias("minute")).agg(F.count(F.lit(1)).alias("placements"))
