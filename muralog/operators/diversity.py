"""Users who place many pixels in few colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.operators.charts import histogram
from muralog.operators.cohorts import placements_of


def color_use(df: DataFrame) -> DataFrame:
    """`user_id, total_colors, total_edits, top_color_edits, color_diversity_ratio` per user.

    Counted per (user, colour) first and then per user: both steps combine on the
    map side, and the second one sees at most one row per user and colour. The
    count of colours leaves NULL out.
    """
    per_color = df.groupBy("user_id", "pc").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_color.groupBy("user_id")
        .agg(F.count("pc").alias("total_colors"), F.sum("n").alias("total_edits"), F.max("n").alias("top_color_edits"))
        .withColumn("color_diversity_ratio",
                    F.try_divide(F.col("total_colors").cast("double"), F.col("total_edits").cast("double")))
    )


def low_diversity_users(df: DataFrame, min_edits: int = 200, max_colors: int = 2, use: DataFrame | None = None) -> DataFrame:
    """Users with more than `min_edits` edits in at most `max_colors` colours, most extreme first.

    Here and below, `use` is `color_use(df)` where it has been computed already.
    """
    return (
        (color_use(df) if use is None else use)
        .filter((F.col("total_edits") > min_edits) & (F.col("total_colors") <= max_colors))
        .select("user_id", "total_colors", "total_edits", "color_diversity_ratio")
        .orderBy("color_diversity_ratio", F.desc("total_edits"), "user_id")
    )


def cohort_placements(df: DataFrame, users: DataFrame) -> DataFrame:
    """`x, y` of every placement by the given users."""
    return placements_of(df.select("user_id", "x", "y"), users).select("x", "y")


def top_cohort_placements(df: DataFrame, users: DataFrame, n: int = 5) -> DataFrame:
    """`user_id, x, y` of the placements by the n most extreme users."""
    chosen = users.orderBy("color_diversity_ratio", F.desc("total_edits"), "user_id").limit(n)
    return placements_of(df.select("user_id", "x", "y"), chosen)


def dominant_color_share(df: DataFrame, use: DataFrame | None = None) -> DataFrame:
    """`user_id, dominant_color_share`: part of a user's edits made in the most used colour."""
    return (color_use(df) if use is None else use).select(
        "user_id",
        (F.col("top_color_edits").cast("double") / F.col("total_edits")).alias("dominant_color_share"),
    )


def color_diversity_distribution(df: DataFrame, bins: int = 50, use: DataFrame | None = None) -> DataFrame:
    """Histogram of colours per edit over all users."""
    return histogram(color_use(df) if use is None else use, "color_diversity_ratio", bins)


def user_spread(df: DataFrame, users: DataFrame) -> DataFrame:
    """`user_id, placements, center_x, center_y, spread` of the given users.

    `spread` is the root mean squared distance from the user's mean position: small where all
    placements lie in one place.
    """
    return placements_of(df.select("user_id", "x", "y"), users).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("placements"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))
