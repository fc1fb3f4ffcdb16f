"""Small tables that answer questions about any window without reading placements again.

Distinct users are kept as HyperLogLog sketches and values as KLL sketches, one per time slot and group.
Sketches of slots merge to that of their union, with the same error as if it had been built at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.functions.clock import within

# 2 ** LG_K registers: a relative standard error of 1.04 / 64.
LG_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
# Points that a quantile sketch keeps of each level, and the rank error that follows with 99 % confidence.
KLL_K = 200
RANK_ERROR = 0.0133


def activity_rollup(df: DataFrame, unit: str = "minute", by: Sequence[str] = ("pc",), user: str = "user_id") -> DataFrame:
    """`slot, <by>, placements, users`: counts and a sketch of the users of each time slot and group.

    Sketches are filled on the map side, so a busy minute is one small row per task before the shuffle.
    Placements without a time are left out; NULL users count as placements only.
    """
    slot = F.date_trunc(unit, "ts").alias("slot")
    return df.filter(F.col("ts").isNotNull()).groupBy(slot, *by).agg(
        F.count(F.lit(1)).alias("placements"), F.hll_sketch_agg(user, F.lit(LG_K)).alias("users"))


def distinct_users(rollup: DataFrame, start=None, end=None, by: Sequence[str] = ()) -> DataFrame:
    """`<by>, placements, users` over the slots that begin in `[start, end)`: exact counts, estimated distinct users.

    The estimate is off by about `DISTINCT_ERROR` of itself. Without groups there is one row, zero over no slot.
    """
    slots = rollup if start is None else rollup.filter(within(F.col("slot"), start, end))
    merged = slots.groupBy(*by).agg(F.coalesce(F.sum("placements"), F.lit(0)).alias("placements"), F.hll_union_agg("users").alias("_users"))
    return merged.select(*by, "placements", F.coalesce(F.hll_sketch_estimate("_users"), F.lit(0)).alias("users"))


def value_rollup(df: DataFrame, value: str, ts: str = "ts", unit: str = "hour", by: Sequence[str] = ()) -> DataFrame:
    """`slot, <by>, n, sketch`: a quantile sketch of a numeric column for each time slot and group; NULL values are left out."""
    known = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.date_trunc(unit, ts).alias("slot"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("sketch"))


def percentiles(rollup: DataFrame, shares: Sequence[float], start=None, end=None, by: Sequence[str] = ()) -> DataFrame:
    """`<by>, n, percentile, value` over the slots that begin in `[start, end)`.

    The value's true rank is within `RANK_ERROR` of the asked share. `n` is exact. Groups without a value give no row.
    """
    slots = rollup if start is None else rollup.filter(within(F.col("slot"), start, end))
    merged = slots.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_sketch")).filter("n > 0")
    asked = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("percentile"), F.kll_sketch_get_quantile_double("_sketch", F.lit(float(s))).alias("value")) for s in shares]))
    return merged.select(*by, "n", asked.alias("_asked")).select(*by, "n", "_asked.percentile", "_asked.value")
