"""Bin expressions for chart tables and sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1 over `[low, high]`; the top edge joins the last bin.

    When low equals high the quotient is NULL and every value lands in bin 0,
    because `greatest` skips NULLs.
    """
    share = F.try_divide((value - low) * F.lit(bins), high - low)
    place = F.floor(share).cast("int")
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))


def right_closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1 whose intervals are closed on the right.

    The lowest value joins bin 0. When low equals high the range is taken to
    extend evenly to both sides of it, which puts the value in the middle bin.
    """
    share = F.try_divide((value - low) * F.lit(bins), high - low)
    place = (F.ceil(share) - 1).cast("int")
    middle = (bins + 1) // 2 - 1
    return F.when(low == high, F.lit(middle)).otherwise(F.greatest(F.lit(0), place))
