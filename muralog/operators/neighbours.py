"""Previous and next row of the same key, also where one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

# A key with more rows than this is ordered in pieces of about half as many.
TARGET_ROWS = 5_000_000
MOST_PIECES = 40_000


def heavy_keys(df: DataFrame, keys: Sequence[str], target_rows: int) -> DataFrame:
    """Keys with more than `target_rows` rows and their number `n`, NULL among them.

    There are at most (rows / target_rows) of them. The counts are combined on the map side, and
    only the keys are read.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target_rows)


def heavy_pieces(df: DataFrame, heavy: DataFrame, keys: Sequence[str], piece_rows: int) -> DataFrame:
    """The rows of heavy keys with `_piece`, consecutive runs in (key, ts, event_id) order.

    The pieces come from a range partitioning of just these rows, so they are even in rows however
    the rows lie in time: a burst is cut, and so is one instant. They are written as they are cut,
    because the bounds are estimated anew on every run.
    """
    total = heavy.agg(F.sum("n")).first()[0]
    hot = _matching(df, heavy, keys, "left_semi")
    pieces = hot.repartitionByRange(max(2, min(MOST_PIECES, -(-2 * total // piece_rows))), *keys, "ts", "event_id")
    return stage(pieces.withColumn("_piece", F.spark_partition_id()), "heavy-pieces")


def with_neighbours(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS, piece_rows: int | None = None) -> DataFrame:
    """Add `prev_ts`, `next_ts` and `earlier_rows` within the key, in (ts, event_id) order.

    Rows of ordinary keys are ordered in one window. A key that is too long for that is cut into
    pieces of about half of `piece_rows` (by default `target_rows`): each piece is ordered on its own,
    and a summary of the pieces (first instant, last instant, length) supplies what lies across their edges.
    """
    heavy = heavy_keys(df, keys, target_rows)
    if heavy.agg(F.max("n")).first()[0] is None:
        return _ordered(df, list(keys))
    heavy = stage(heavy, "heavy-keys")
    cut = heavy_pieces(df, heavy, keys, piece_rows or target_rows)
    parts = [*keys, "_piece"]

    summary = cut.groupBy(*parts).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy(*keys).orderBy("_piece")
    edges = stage(summary.select(
        *parts,
        F.lag("last_ts").over(across).alias("_before_ts"),
        F.lead("first_ts").over(across).alias("_after_ts"),
        F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before_rows"),
    ), "piece-edges")
    stitched = _matching(_ordered(cut, parts), edges, parts, "left").select(
        *df.columns,
        F.coalesce("prev_ts", "_before_ts").alias("prev_ts"),
        F.coalesce("next_ts", "_after_ts").alias("next_ts"),
        (F.col("earlier_rows") + F.coalesce("_before_rows", F.lit(0))).alias("earlier_rows"),
    )
    return _ordered(_matching(df, heavy, keys, "left_anti"), list(keys)).unionByName(stitched)


def _matching(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a small staged table on keys that may be NULL."""
    named = small.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(broadcast_if_small(named), same, how)


def _ordered(df: DataFrame, parts: list[str]) -> DataFrame:
    w = Window.partitionBy(*parts).orderBy("ts", "event_id")
    return df.select(
        "*",
        F.lag("ts").over(w).alias("prev_ts"),
        F.lead("ts").over(w).alias("next_ts"),
        (F.row_number().over(w) - 1).cast("long").alias("earlier_rows"),
    )
