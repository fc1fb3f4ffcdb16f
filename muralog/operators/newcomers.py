"""First-time users: surges of them, and how long they stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.functions.clock import crossed_minutes, crossed_seconds, in_unit, instant, unit_end
from muralog.operators.cohorts import placements_of
from muralog.sources.placements import before, during
from muralog.sources.scratch import sized


def user_bounds(df: DataFrame) -> DataFrame:
    """`user_id, first_ts, last_ts` for every user."""
    return df.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def newcomers_per_minute(df: DataFrame, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """`minute, first_time_users` for the units that saw any.

    Here and below, `bounds` is `user_bounds(df)` where it has been computed already.
    """
    firsts = df.groupBy("user_id").agg(F.min("ts").alias("first_ts")) if bounds is None else bounds
    return (
        firsts.groupBy(F.date_trunc(unit, "first_ts").alias("minute"))
        .agg(F.count("user_id").alias("first_time_users"))
    )


def spike_first_time_users(df: DataFrame, minute, unit: str = "minute") -> DataFrame:
    """Users whose first placement lies in that unit, one row; later placements are not read."""
    return _bounds_from(before(df, unit_end(unit, minute)), minute, unit).agg(F.count(F.lit(1)).alias("first_time_users"))


def first_time_user_baseline(df: DataFrame, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """Mean and sample deviation of first-time users, over the units that saw any, one row."""
    return newcomers_per_minute(df, unit, bounds).agg(
        F.avg("first_time_users").alias("mean_first_users_per_minute"),
        F.stddev_samp("first_time_users").alias("std_first_users_per_min"),
    )


def spike_summary(df: DataFrame, minute, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """How far one unit stands out from the baseline, one row.

    The count of the unit and the baseline come from the same aggregate over the
    per-unit counts, so users are grouped once.
    """
    spike = instant(minute)
    stats = newcomers_per_minute(df, unit, bounds).agg(
        F.coalesce(F.max(F.when(F.col("minute") == spike, F.col("first_time_users"))), F.lit(0)).alias("spike_count"),
        F.avg("first_time_users").alias("mean_count"),
        F.stddev_samp("first_time_users").alias("std_count"),
    )
    z = F.try_divide(F.col("spike_count") - F.col("mean_count"), F.col("std_count"))
    return stats.select(spike.alias("spike_minute"), "spike_count", "mean_count", "std_count", z.alias("z_score"))


def new_user_spikes(df: DataFrame, z: float = 4.0, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """Every unit whose first-time users lie at least `z` deviations above the mean."""
    counts = newcomers_per_minute(df, unit, bounds)
    baseline = counts.agg(F.struct(F.avg("first_time_users").alias("mean"),
                                   F.stddev_samp("first_time_users").alias("std")).alias("b")).scalar()
    score = F.try_divide(F.col("first_time_users") - baseline["mean"], baseline["std"])
    return (
        counts.withColumn("z_score", score).filter(F.col("z_score") >= z)
        .orderBy(F.desc("z_score"), "minute")
    )


def spike_lifespans(df: DataFrame, minute, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """Active span of each user who first appeared in that unit, longest first."""
    return spike_spans(df, minute, unit, bounds).orderBy(F.desc("lifespan_minutes"), "user_id")


def spike_lifespan_summary(df: DataFrame, minute, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample deviation, median and 90th percentile of those spans in minutes, one row."""
    return spike_spans(df, minute, unit, bounds).agg(
        F.count(F.lit(1)).alias("spike_new_users"),
        F.avg("lifespan_minutes").alias("avg_lifespan_min"),
        F.stddev_samp("lifespan_minutes").alias("std_lifespan_min"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY lifespan_minutes)").alias("median_lifespan_min"),
        F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY lifespan_minutes)").alias("p90_lifespan_min"),
    )


def lifespan_cohort_placements(df: DataFrame, lifespans: DataFrame,
                               max_minutes: int | None = None, min_minutes: int | None = None) -> DataFrame:
    """`x, y` of the placements by users whose span is at most / at least the given minutes.

    An empty cohort gives an empty result.
    """
    cohort = lifespans
    if max_minutes is not None:
        cohort = cohort.filter(F.col("lifespan_minutes") <= max_minutes)
    if min_minutes is not None:
        cohort = cohort.filter(F.col("lifespan_minutes") >= min_minutes)
    return placements_of(df.select("user_id", "x", "y"), cohort).select("x", "y")


def spike_spans(df: DataFrame, minute, unit: str = "minute", bounds: DataFrame | None = None) -> DataFrame:
    """`spike_lifespans` in no order, for what is computed from them."""
    if bounds is None:
        found = _bounds_from(df, minute, unit)
    else:
        found = bounds.filter(in_unit(F.col("first_ts"), unit, minute))
    return found.select(
        "user_id", "first_ts", "last_ts",
        crossed_minutes("first_ts", "last_ts").alias("lifespan_minutes"),
        crossed_seconds("first_ts", "last_ts").alias("lifespan_seconds"),
    )


def _bounds_from(df: DataFrame, minute, unit: str) -> DataFrame:
    """`user_bounds` of the users whose first placement lies in that unit.

    Only users who placed anything in the unit can qualify, so the scan drops everybody else
    and the grouping moves their bounds only. How their ids are joined follows from their number.
    """
    active = sized(during(df, unit, minute).select("user_id").distinct(), "unit-users")
    return user_bounds(df.join(active, "user_id", "left_semi")).filter(in_unit(F.col("first_ts"), unit, minute))
