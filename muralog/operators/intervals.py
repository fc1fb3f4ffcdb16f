"""Joins of intervals with the events that lie in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.functions.clock import MICROS, micros
from muralog.operators.features import grid_cell
from muralog.sources.scratch import broadcast_if_small, stage

# A time bucket with more events, or more intervals, than this is split.
TARGET_ROWS = 100_000


def bucket_range(start: Column, end: Column, width: int) -> Column:
    """Numbers of the buckets, `width` microseconds wide, that `[start, end)` meets; none if it is empty."""
    first, last = (F.floor(t / F.lit(width)).cast("long") for t in (start, end - 1))
    return F.when(start < end, F.sequence(first, last))


def bucket_pieces(events: DataFrame, asked: DataFrame, cell: Sequence[str], target_rows: int) -> DataFrame:
    """`cell` columns with `event_pieces` and `asked_pieces` of the buckets that are split.

    A bucket is only listed if one side of it is longer than the target, so the table is short: rows of
    both sides over the target at most.
    """
    count = lambda df, name: df.groupBy(*cell).agg(F.count(F.lit(1)).alias(name))
    pieces = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / target_rows), F.lit(1)).cast("long")
    large = [count(df, name).filter(F.col(name) > target_rows) for df, name in ((events, "_events"), (asked, "_asked"))]
    both = large[0].join(large[1], list(cell), "full")
    return stage(both.select(*cell, pieces(F.col("_events")).alias("event_pieces"), pieces(F.col("_asked")).alias("asked_pieces")), "split-buckets")


def interval_join(asked: DataFrame, events: DataFrame, keys: Sequence[str], start: Column, end: Column, width_seconds: float,
                  target_rows: int = TARGET_ROWS, ts: str = "ts", asked_id: str = "event_id", event_id: str = "event_id",
                  how: str = "inner") -> DataFrame:
    """Each asked row with the events of its keys in `[start, end)`, events' columns as `near_<column>`.

    `start` and `end` are timestamp expressions over the asked rows. Both sides are put into buckets of
    time, an interval into every bucket that it meets, and joined on keys and bucket; each match lies in
    one bucket, so none is found twice. In a bucket with more rows than the target, events are dealt into
    pieces by their id and each interval goes to all of them, and likewise the other way round: a burst of
    events, or of intervals, is spread over tasks, and no pair is lost. `how` is inner or left. NULL keys,
    times and bounds meet nothing; rows that repeat match as often as they occur.
    """
    width = int(width_seconds * MICROS)
    renamed = [F.col(c).alias(f"near_{c}") for c in events.columns]
    asked = asked.withColumns({"_start": micros(start), "_end": micros(end), "_row": F.monotonically_increasing_id()})
    asked = stage(asked, "intervals")
    wanted = asked.select("_row", F.col(asked_id).alias("_asked_id"), *[F.col(k).alias(f"_{k}") for k in keys], "_start", "_end",
                          F.explode(bucket_range(F.col("_start"), F.col("_end"), width)).alias("_bucket"))
    at = micros(F.col(f"near_{ts}"))
    there = events.select(*renamed).withColumns({f"_{k}": F.col(f"near_{k}") for k in keys}).withColumn("_bucket", F.floor(at / F.lit(width)).cast("long"))
    cell = [*[f"_{k}" for k in keys], "_bucket"]

    split = bucket_pieces(there, wanted, cell, target_rows)
    if split.isEmpty():
        pairs = there.join(wanted, cell)
    else:
        own = lambda row, pieces: F.pmod(F.xxhash64(row), F.coalesce(pieces, F.lit(1)))
        all_of = lambda pieces: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(pieces, F.lit(1)) - 1))
        marked = [df.join(broadcast_if_small(split), cell, "left") for df in (there, wanted)]
        dealt_events = marked[0].withColumn("_piece", own(f"near_{event_id}", F.col("event_pieces"))).withColumn("_part", all_of(F.col("asked_pieces"))).drop("event_pieces", "asked_pieces")
        dealt_asked = marked[1].withColumn("_part", own("_row", F.col("asked_pieces"))).withColumn("_piece", all_of(F.col("event_pieces"))).drop("event_pieces", "asked_pieces")
        pairs = dealt_events.join(dealt_asked, [*cell, "_piece", "_part"])
    inside = pairs.filter((at >= F.col("_start")) & (at < F.col("_end")))
    found = inside.select(F.col("_row"), *[f"near_{c}" for c in events.columns])
    columns = [c for c in asked.columns if c not in ("_start", "_end", "_row")]
    return asked.select("_row", *columns).join(found, "_row", how).select(*columns, *[f"near_{c}" for c in events.columns])


def interval_aggregate(asked: DataFrame, events: DataFrame, keys: Sequence[str], start: Column, end: Column, width_seconds: float,
                       aggregates: Sequence[Column], **join) -> DataFrame:
    """Asked rows' ids with any aggregates over the events of their keys in `[start, end)`; rows without any event stay."""
    asked_id = join.get("asked_id", "event_id")
    return interval_join(asked, events, keys, start, end, width_seconds, how="left", **join).groupBy(asked_id).agg(*aggregates)


def neighbors_before(full: DataFrame, sample: DataFrame, size: int = 20, lookback_minutes: float = 10, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The placements themselves that lie in the cell of a sampled one in `[t - lookback, t)`.

    `event_id, near_event_id, near_user_id, near_pc, seconds_before`, one row for each pair.
    """
    events = grid_cell(full.select("event_id", "ts", "user_id", "pc", "x", "y"), size).select("event_id", "ts", "user_id", "pc", "gx", "gy")
    asked = grid_cell(sample.select("event_id", "ts", "x", "y"), size)
    lookback = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_minutes * 60).cast("decimal(18,6)"))
    pairs = interval_join(asked, events, ["gx", "gy"], F.col("ts") - lookback, F.col("ts"), lookback_minutes * 60, target_rows)
    return pairs.select("event_id", "near_event_id", "near_user_id", "near_pc",
                        ((micros("ts") - micros("near_ts")) / F.lit(1e6)).alias("seconds_before"))


def neighborhood_profile(full: DataFrame, sample: DataFrame, size: int = 20, lookback_minutes: float = 10, target_rows: int = TARGET_ROWS) -> DataFrame:
    """What sums of steps can't say of the placements before a sampled one: who was last, the commonest colour's share, how far off they were.

    `event_id, n_near, last_near_event_id, mean_seconds_before, same_color_share`; NULL without any placement.
    """
    events = grid_cell(full.select("event_id", "ts", "user_id", "pc", "x", "y"), size).select("event_id", "ts", "pc", "gx", "gy")
    asked = grid_cell(sample.select("event_id", "ts", "x", "y", "pc"), size)
    lookback = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_minutes * 60).cast("decimal(18,6)"))
    before = micros("ts") - micros("near_ts")
    return interval_aggregate(asked, events, ["gx", "gy"], F.col("ts") - lookback, F.col("ts"), lookback_minutes * 60, [
        F.count("near_event_id").alias("n_near"),
        F.max(F.struct("near_ts", "near_event_id"))["near_event_id"].alias("last_near_event_id"),
        (F.sum(before) / F.count("near_event_id") / F.lit(1e6)).alias("mean_seconds_before"),
        F.avg(F.when(F.col("near_event_id").isNotNull(), F.col("pc").eqNullSafe(F.col("near_pc")).cast("int"))).alias("same_color_share"),
    ], target_rows=target_rows)
