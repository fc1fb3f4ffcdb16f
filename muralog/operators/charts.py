"""Chart-ready tables: binned before anything leaves the cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.functions.bins import left_closed_bin, right_closed_bin
from muralog.sources.scratch import stage


def extent(df: DataFrame, columns: Sequence[str]) -> Column:
    """Smallest and largest value of each column, as one scalar struct `lo_<c>`, `hi_<c>`.

    A scalar subquery: Spark runs it first and puts the values into the plan.
    """
    ends = [f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]
    return df.agg(F.struct(*ends).alias("extent")).scalar()


def histogram(df: DataFrame, column: str, bins: int, log10: bool = False) -> DataFrame:
    """`bin, bin_low, bin_high, n`: counts in equal-width bins over the observed range.

    With `log10` the bins have equal width on the logarithmic axis, and values
    that have no logarithm are counted in bin -1, which has no edges. NULLs are
    left out. Only `bins` rows per task are shuffled; the range is a second look
    at the values, which reuses the shuffles they came from.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    axis = F.when(F.col("v") > 0, F.log10("v")) if log10 else F.col("v")
    placed = values.select(axis.alias("a"))
    ends = extent(placed, ["a"])
    low, high = ends["lo_a"], ends["hi_a"]
    step = (high - low) / F.lit(bins)

    place = F.when(F.col("a").isNull(), F.lit(-1)).otherwise(left_closed_bin(F.col("a"), low, high, bins))
    edge = F.when(F.col("bin") >= 0, low + F.col("bin") * step)
    next_edge = F.when(F.col("bin") >= 0, low + (F.col("bin") + 1) * step)
    if log10:
        edge, next_edge = F.pow(F.lit(10.0), edge), F.pow(F.lit(10.0), next_edge)
    return (
        placed.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", edge.alias("bin_low"), next_edge.alias("bin_high"), "n")
        .orderBy("bin")
    )


def bin2d(df: DataFrame, bins: int, facet: str | None = None) -> DataFrame:
    """`[facet,] x_bin, y_bin, n`: counts on a grid over the observed range, shared by all facets.

    Rows are counted per pixel first; range and bins are then looked up on that table, which is no
    larger than the canvas (per facet).
    """
    group = [facet] if facet else []
    pixels = stage(df.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("n")), "pixel-counts")
    return (
        pixels.groupBy(*group, *_grid(pixels, bins, left_closed_bin))
        .agg(F.sum("n").alias("n"))
        .orderBy(*group, "x_bin", "y_bin")
    )


def binned_mean_map(df: DataFrame, value: str = "survival_prob", bins: int = 120) -> DataFrame:
    """`x_bin, y_bin, avg_<value>` on a grid of right-closed bins over the observed range, of all rows."""
    pixels = stage(df.groupBy("x", "y").agg(F.sum(value).alias("total"), F.count(value).alias("n")), "pixel-sums")
    return (
        pixels.groupBy(*_grid(pixels, bins, right_closed_bin))
        .agg(F.try_divide(F.sum("total"), F.sum("n")).cast("double").alias(f"avg_{value}"))
        .orderBy("x_bin", "y_bin")
    )


def _grid(df: DataFrame, bins: int, rule: Callable[..., Column]) -> list[Column]:
    ends = extent(df, ["x", "y"])
    return [
        rule(F.col(c).cast("double"), ends[f"lo_{c}"].cast("double"), ends[f"hi_{c}"].cast("double"), bins)
        .alias(f"{c}_bin")
        for c in ("x", "y")
    ]
