"""Surges against a running, robust baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.functions.clock import micros
from muralog.operators.newcomers import newcomers_per_minute


def middle(values: Column) -> Column:
    """Median of an array; the mean of the two middle values of an even number, NULL of none."""
    ordered, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / F.lit(2.0))


def running_baseline(counts: DataFrame, value: str, slot: str = "minute", unit_seconds: int = 60, cycle_seconds: int = 86_400, periods: int = 28, least: int = 4) -> DataFrame:
    """All columns and `median`, `mad`, `score` of each slot against the slots at the same time of up to `periods` earlier cycles.

    `score` is the distance from the median in median absolute deviations, scaled as a normal deviation;
    a deviation of 0 counts as 1. Only earlier slots count, so a spike does not raise its own baseline, and
    as half of them would have to be spikes to move a median, neither does it hide the next one. With fewer
    than `least` earlier slots there is no score. Slots that saw nothing are not in `counts` and no part of it.

    `counts` has a row per slot, so the window is over the slots at one time of the cycle, and each row
    sees `periods` others.
    """
    phase = F.floor(F.pmod(micros(slot), F.lit(cycle_seconds * 1_000_000)) / F.lit(unit_seconds * 1_000_000)).cast("long")
    earlier = Window.partitionBy("_phase").orderBy(slot).rowsBetween(-periods, -1)
    seen = counts.withColumn("_phase", phase).withColumn("_seen", F.collect_list(F.col(value).cast("double")).over(earlier))
    median = seen.withColumn("median", F.when(F.size("_seen") >= least, middle(F.col("_seen"))))
    mad = median.withColumn("mad", F.when(F.col("median").isNotNull(), middle(F.transform("_seen", lambda v: F.abs(v - F.col("median"))))))
    scale = F.greatest(F.col("mad"), F.lit(0.0))
    score = (F.col(value) - F.col("median")) / (F.when(scale == 0, F.lit(1.0)).otherwise(scale) * F.lit(1.4826))
    return mad.withColumn("score", score).drop("_phase", "_seen")


def running_spikes(df: DataFrame, threshold: float = 4.0, unit: str = "minute", unit_seconds: int = 60, bounds: DataFrame | None = None, **baseline) -> DataFrame:
    """Units whose first-time users stand out from those at the same time of earlier days: `minute, first_time_users, median, mad, score`."""
    counts = newcomers_per_minute(df, unit, bounds)
    return running_baseline(counts, "first_time_users", "minute", unit_seconds, **baseline).filter(F.col("score") >= threshold)
