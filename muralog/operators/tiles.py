"""Counts of the canvas at every zoom: a tile pyramid over one interleaved key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """The bits of `x` and `y` in turn, x lowest: tiles of any power of two are runs of keys with a common prefix."""
    turned = [(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1))) * F.lit(1 << (2 * i + k)) for i in range(bits) for k, c in ((0, x), (1, y))]
    return reduce(add, turned)


def unmorton(key: Column, bits: int = 16) -> tuple[Column, Column]:
    """Both coordinates of a key."""
    return tuple(reduce(add, [F.shiftright(key, 2 * i + k).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i in range(bits)]) for k in (0, 1))


def tile_pyramid(df: DataFrame, levels: int = 11, value: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """`<by>, level, x_tile, y_tile, n[, total]` for all tiles that hold a placement.

    At `level` 0 a tile is a pixel, and each level's tiles are two by two of the one below. Placements are
    counted per pixel once, which combines on the map side; all levels are then prefixes of the pixel's key
    in one aggregate. Coordinates must not be negative; rows without one are left out. With `value` also the
    sum of that column, NULL where it has no value.
    """
    bits = 16
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    pixels = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*by, "x", "y").agg(*sums)
    keyed = pixels.withColumn("_key", morton(F.col("x"), F.col("y"), bits))
    raised = keyed.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(levels)]))).withColumn("_tile", F.expr("shiftright(_key, 2 * level)"))
    tiles = raised.groupBy(*by, "level", "_tile").agg(F.sum("n").alias("n"), *([F.sum("total").alias("total")] if value else []))
    x, y = unmorton(F.col("_tile"), bits)
    return tiles.select(*by, "level", x.cast("int").alias("x_tile"), y.cast("int").alias("y_tile"), "n", *(["total"] if value else []))
