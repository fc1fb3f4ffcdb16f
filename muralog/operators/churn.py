"""Contested pixels and the users behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.operators.cohorts import placements_of
from muralog.sources.scratch import sized


def pixel_churn(df: DataFrame) -> DataFrame:
    """`x, y, edits` for every pixel that was ever set."""
    return df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("edits"))


def high_churn_pixels(df: DataFrame, min_edits: int = 50) -> DataFrame:
    """Pixels with more than `min_edits` edits, most edited first."""
    return pixel_churn(df).filter(F.col("edits") > min_edits).orderBy(F.desc("edits"), "x", "y")


def hot_pixels(df: DataFrame, min_edits: int = 100) -> DataFrame:
    """`x, y` of the pixels with more than `min_edits` edits."""
    return pixel_churn(df).filter(F.col("edits") > min_edits).select("x", "y")


def hot_pixel_users(df: DataFrame, hot: DataFrame) -> DataFrame:
    """`user_id, edits_on_hot_pixels`, busiest first.

    `hot` is a filter on placements: where its counted size allows a broadcast,
    placements are not shuffled by pixel, and only counts per user move.
    """
    hot = sized(hot.select("x", "y"), "hot-pixels")
    on_hot = df.select("user_id", "x", "y").join(hot, ["x", "y"], "left_semi")
    return (
        on_hot.groupBy("user_id").agg(F.count(F.lit(1)).alias("edits_on_hot_pixels"))
        .orderBy(F.desc("edits_on_hot_pixels"), "user_id")
    )


def top_users(users: DataFrame, n: int = 50) -> DataFrame:
    """The first n users by edits on hot pixels; ties go to the smaller id."""
    return users.orderBy(F.desc("edits_on_hot_pixels"), "user_id").limit(n)


def hot_edit_focus(df: DataFrame, users: DataFrame, hot: DataFrame) -> DataFrame:
    """Share of each given user's edits that fell on hot pixels, most focused first.

    Placements are read once: total and hot edits are counted in the same
    aggregate, which combines on the map side.
    """
    hot = sized(hot.select("x", "y"), "hot-pixels").withColumn("is_hot", F.lit(1))
    flagged = placements_of(df.select("user_id", "x", "y"), users).join(hot, ["x", "y"], "left")
    return (
        flagged.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_edits"), F.count("is_hot").alias("hot_edits"))
        .withColumn("hot_edit_ratio", F.col("hot_edits").cast("double") / F.col("total_edits"))
        .orderBy(F.desc("hot_edit_ratio"), "user_id")
    )
