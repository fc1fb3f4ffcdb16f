"""The place of every row in time: ranks and even folds without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

# Rows of a range that one task sorts.
PIECE_ROWS = 2_000_000
MOST_PIECES = 40_000


def time_rank(df: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All columns and `time_rank`, the 0-based place of each row in (ts, event_id) order.

    Rows without `ts` come last, rows without an id last of their instant. The rows are cut into ranges of
    that order, each range is numbered on its own, and the lengths of the ranges before it are added.
    Equal keys are told apart by where they were read, so a repeated row does not grow a range. The ranges
    are written as they are cut, because their bounds are estimated anew on every run.
    """
    rows = df.count()
    order = [F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"), F.asc("_read")]
    pieces = max(1, min(MOST_PIECES, -(-2 * rows // piece_rows)))
    read = df.withColumn("_read", F.monotonically_increasing_id())
    cut = stage(read.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()), "time-ranges")

    # One row per range.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    lengths = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
    starts = stage(lengths.select("_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "range-starts")
    inside = cut.withColumn("_place", F.row_number().over(Window.partitionBy("_piece").orderBy(*order)))
    return inside.join(broadcast_if_small(starts), "_piece").select(
        *df.columns, (F.col("_start") + F.col("_place") - 1).alias("time_rank"))


def fold_of(rank: Column, rows: int, folds: int) -> Column:
    """Number (from 1) of the even fold that a 0-based rank falls in; the earlier folds are one longer."""
    each, longer = divmod(rows, folds)
    in_longer = F.floor(rank / F.lit(each + 1))
    in_rest = longer + F.floor((rank - longer * (each + 1)) / F.lit(max(each, 1)))
    return (F.when(rank < longer * (each + 1), in_longer).otherwise(in_rest) + 1).cast("int")


def time_fold(df: DataFrame, folds: int = 5, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All columns and `fold`, from 1 to `folds`: even parts of the rows in (ts, event_id) order.

    With fewer rows than folds each row has a fold of its own. An empty table gives no rows.
    """
    ranked = time_rank(df, piece_rows)
    return ranked.withColumn("fold", fold_of(F.col("time_rank"), ranked.count(), folds)).drop("time_rank")


def forward_chaining(folded: DataFrame, folds: int = 5, first: int = 2) -> list[tuple[DataFrame, DataFrame]]:
    """Cross-validation by time: for each fold from `first` on, all rows before it and the rows of it."""
    return [(folded.filter(F.col("fold") < k), folded.filter(F.col("fold") == k)) for k in range(first, folds + 1)]


def fold_summary(folded: DataFrame) -> DataFrame:
    """`fold, n, first_ts, last_ts`: how the folds lie in time."""
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
