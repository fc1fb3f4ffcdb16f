"""Baseline statistics of a time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muralog.functions.clock import instant
from muralog.functions.palette import with_color_name
from muralog.sources.placements import before, in_window


def color_rank(df: DataFrame, start, end) -> DataFrame:
    """Colours by distinct users in `[start, end)`, numbered from 1.

    Codes outside the palette form one NULL group. The distinct count is resolved
    on (colour, user) first, so a colour that nearly everybody used is spread over
    all tasks; only palette-many rows reach the numbering window.
    """
    users = (
        with_color_name(in_window(df, start, end).select("ts", "user_id", "pc"))
        .groupBy("color")
        .agg(F.countDistinct("user_id").alias("user_count"))
    )
    order = Window.orderBy(F.desc("user_count"), F.asc_nulls_last("color"))
    return users.select(F.row_number().over(order).alias("position"), "color", "user_count").orderBy("position")


def placement_percentiles(df: DataFrame, start, end,
                          shares: Sequence[float] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Discrete percentiles of placements per user in `[start, end)`, one row.

    The percentile keeps a count per distinct value, and counts per user take few
    distinct values, so its state stays small however many users there are.
    """
    per_user = in_window(df, start, end).groupBy("user_id").agg(F.count(F.lit(1)).alias("placements"))
    return per_user.agg(*[
        F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY placements)").cast("long").alias(f"p{share * 100:g}")
        for share in shares
    ])


def first_time_users(df: DataFrame, start, end) -> DataFrame:
    """Users whose first placement ever lies in `[start, end)`, one row.

    Placements from `end` on cannot change the answer, so they are not read.
    """
    firsts = before(df, end).groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    return firsts.filter(F.col("first_ts") >= instant(start)).agg(F.count(F.lit(1)).alias("first_time_users"))
