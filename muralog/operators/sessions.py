"""Sessions: runs of a user's placements without a long pause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muralog.functions.clock import MICROS, crossed_minutes, crossed_seconds, micros, seconds_between, slot_start
from muralog.operators.cohorts import placements_of
from muralog.operators.neighbours import with_neighbours
from muralog.sources.placements import in_window


def activity_slots(df: DataFrame, keys: Sequence[str], gap_seconds: float) -> DataFrame:
    """Collapse events to one row per key and gap-wide time slot: `first_ts, last_ts, events`.

    Two events in the same slot are less than one gap apart, so they are always in
    the same run and no run boundary is lost. The collapse is a plain aggregate
    with map-side combine: a key that holds a large part of the table shrinks to
    at most (time span / gap) rows before anything is ordered by key.
    """
    return (
        df.groupBy(*keys, slot_start("ts", int(gap_seconds * MICROS)).alias("slot"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    )


def sessions(df: DataFrame, gap_seconds: float, min_events: int = 1) -> DataFrame:
    """`user_id, session_id, start_ts, end_ts, events`; ids count from 1 in time order.

    A pause longer than the gap opens a new session; a pause of exactly the gap
    does not. Users with fewer than `min_events` events are left out.
    """
    by_user = Window.partitionBy("user_id")
    in_order = by_user.orderBy(F.asc_nulls_last("slot"))
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag("last_ts").over(in_order)
    pause = micros("first_ts") - micros(previous)
    opens = F.when(pause <= F.lit(int(gap_seconds * MICROS)), 0).otherwise(1)

    slots = activity_slots(df, ["user_id"], gap_seconds).withColumn("opens", opens)
    if min_events > 1:
        slots = slots.withColumn("user_events", F.sum("events").over(by_user)).filter(F.col("user_events") >= min_events)
    return (
        slots.withColumn("session_id", F.sum("opens").over(running))
        .groupBy("user_id", "session_id")
        .agg(F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"), F.sum("events").alias("events"))
    )


def avg_session_length(df: DataFrame, start, end, gap_seconds: float = 15 * 60) -> DataFrame:
    """Mean session length in seconds in `[start, end)` over users with more than one placement.

    A session of one placement counts with length 0.
    """
    found = sessions(in_window(df, start, end), gap_seconds, min_events=2)
    return found.agg(F.avg(crossed_seconds("start_ts", "end_ts")).alias("avg_session_seconds"))


def user_sessions(df: DataFrame, users: DataFrame | None = None, gap_seconds: float = 30 * 60) -> DataFrame:
    """Sessions of the given users, or of all users, with their length in minutes."""
    events = df if users is None else placements_of(df, users)
    return sessions(events, gap_seconds).select(
        "user_id", "session_id", "start_ts", "end_ts",
        crossed_minutes("start_ts", "end_ts").alias("session_length_min"),
    )


def inter_placement_deltas(df: DataFrame, users: DataFrame | None = None, **split) -> DataFrame:
    """`event_id, user_id, ts, delta_seconds` since the same user's previous placement.

    The first placement of a user has no delta (NULL). `split` is passed on to
    `with_neighbours`.
    """
    events = df.select("event_id", "user_id", "ts")
    if users is not None:
        events = placements_of(events, users)
    return with_neighbours(events, ["user_id"], **split).select(
        "event_id", "user_id", "ts", seconds_between("prev_ts", "ts").alias("delta_seconds"),
    )


def user_cadence(deltas: DataFrame, width_seconds: float = 1.0) -> DataFrame:
    """`user_id, deltas, common_interval_sec, common_share`: how regular each user's pauses are.

    Pauses are put into intervals of `width_seconds`; the commonest one of a user is given by its
    start (of equally common ones the shortest), with the share of the user's pauses in it. Counted
    per user and interval first, so a busy user shrinks before the second step.
    """
    interval = F.floor(F.col("delta_seconds") / F.lit(width_seconds)).alias("interval")
    counts = deltas.filter(F.col("delta_seconds").isNotNull()).groupBy("user_id", interval).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(
        F.sum("n").alias("deltas"), F.max(F.struct("n", (-F.col("interval")).alias("back"))).alias("top")).select(
        "user_id", "deltas", (-F.col("top.back") * F.lit(width_seconds)).cast("double").alias("common_interval_sec"),
        (F.col("top.n") / F.col("deltas")).alias("common_share"))
