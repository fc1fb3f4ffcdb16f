"""Users' sessions and first and last times as stored tables that daily batches are merged into.

A store is a folder with two tables, `sessions` and `users`, each with one subfolder per generation. A batch
writes a new generation that holds only the users it touches, with all of their sessions; a user's
newest generation counts. Sessions are written before users, and a generation counts only for the users
listed in it, so a batch that breaks off changes nothing and is simply merged again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muralog.functions.clock import MICROS, crossed_minutes, micros
from muralog.operators.sessions import activity_slots
from muralog.sources.scratch import broadcast_if_small, stage

SESSIONS = "user_id long, start_ts timestamp, end_ts timestamp, events long, gen int"
USERS = "user_id long, first_ts timestamp, last_ts timestamp, events long, gap_micros long, gen int"


def merged_sessions(runs: DataFrame, gap_seconds: float) -> DataFrame:
    """Runs of events (`user_id, start_ts, end_ts, events`) stitched to sessions.

    Runs of a user may overlap, as those of late rows do. A run opens a session if it begins more than
    the gap after the end of all runs that began before it.
    """
    in_order = Window.partitionBy("user_id").orderBy("start_ts", "end_ts")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    pause = micros("start_ts") - micros(F.max("end_ts").over(before))
    opens = F.when(pause <= F.lit(int(gap_seconds * MICROS)), 0).otherwise(1)
    return (
        runs.withColumn("_opens", opens)
        .withColumn("_session", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("user_id", "_session")
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("events").alias("events"))
        .drop("_session")
    )


def append_batch(placements: DataFrame, path: str, gap_seconds: float = 30 * 60) -> int:
    """Merge placements into the store at `path` and return the number of the new generation.

    Batches may come in any order and overlap in time: a late placement prolongs, bridges or precedes the
    stored sessions of its user as if it had been there from the start. Users that the batch does not name
    are neither read beyond their ids nor written. Placements without user or time are left out. The gap is
    part of the store; another one is refused. A batch is one write: two at once need a lock of the caller's.
    """
    spark = placements.sparkSession
    placed = placements.select("user_id", "ts").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    runs = stage(activity_slots(placed, ["user_id"], gap_seconds).select(
        "user_id", F.col("first_ts").alias("start_ts"), F.col("last_ts").alias("end_ts"), "events"), "batch-runs")
    touched = broadcast_if_small(stage(runs.select("user_id").distinct(), "touched-users"))

    users = _table(spark, path, "users", USERS)
    newest, other = users.agg(F.max("gen"), F.max(F.when(F.col("gap_micros") != int(gap_seconds * MICROS), True))).first()
    if other:
        raise ValueError("the store was built with another gap")
    gen = 0 if newest is None else newest + 1

    known = _newest(users.join(touched, "user_id", "left_semi"))
    old = _table(spark, path, "sessions", SESSIONS).join(touched, "user_id", "left_semi").join(
        known.select("user_id", "gen"), ["user_id", "gen"], "left_semi")
    merged = merged_sessions(old.drop("gen").unionByName(runs), gap_seconds)
    merged.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/sessions/gen={gen}")

    written = spark.read.schema(SESSIONS.rpartition(",")[0]).parquet(f"{path}/sessions/gen={gen}")
    written.groupBy("user_id").agg(
        F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"), F.sum("events").alias("events"),
        F.lit(int(gap_seconds * MICROS)).cast("long").alias("gap_micros"),
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/users/gen={gen}")
    return gen


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """`user_id, session_id, start_ts, end_ts, events, session_length_min` as of the last batch."""
    current = _newest(_table(spark, path, "users", USERS)).select("user_id", "gen")
    in_order = Window.partitionBy("user_id").orderBy("start_ts")
    return _table(spark, path, "sessions", SESSIONS).join(current, ["user_id", "gen"], "left_semi").select(
        "user_id", F.row_number().over(in_order).cast("long").alias("session_id"), "start_ts", "end_ts", "events",
        crossed_minutes("start_ts", "end_ts").alias("session_length_min"))


def stored_users(spark: SparkSession, path: str) -> DataFrame:
    """`user_id, first_ts, last_ts, events` as of the last batch."""
    return _newest(_table(spark, path, "users", USERS)).select("user_id", "first_ts", "last_ts", "events")


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """The store as of the last batch, as the one generation of a new store."""
    users = _newest(_table(spark, path, "users", USERS))
    _table(spark, path, "sessions", SESSIONS).join(users.select("user_id", "gen"), ["user_id", "gen"], "left_semi").drop("gen").write.option(
        "compression", "zstd").parquet(f"{new_path}/sessions/gen=0")
    users.drop("gen").write.option("compression", "zstd").parquet(f"{new_path}/users/gen=0")


def _newest(users: DataFrame) -> DataFrame:
    """One row per user, of the last generation that lists it."""
    columns = [c for c in users.columns if c != "user_id"]
    newest = users.groupBy("user_id").agg(F.max(F.struct("gen", *[c for c in columns if c != "gen"])).alias("_last"))
    return newest.select("user_id", *[F.col(f"_last.{c}").alias(c) for c in columns])


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first batch."""
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
