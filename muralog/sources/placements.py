"""The placement table at rest: Parquet, ZSTD, one folder per day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralog.functions.clock import in_unit, instant, unit_end, within

DAY = "event_date"
COLUMNS = ["event_id", "ts", "user_id", "pc", "x", "y"]


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """Read a placement table; the day column stays so that time filters can prune folders."""
    return as_placements(spark.read.parquet(path))


def as_placements(df: DataFrame) -> DataFrame:
    """Bring `ts` to the instant type; a range filter on it still reaches the scan."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def write_placements(df: DataFrame, path: str, mode: str = "error", partitions: int | None = None) -> None:
    """Write placements clustered by time.

    One shuffle on the hour: a task holds a few hours and writes their day folders, sorted, so that
    row-group statistics on `ts` are narrow enough to skip by. Adaptive execution sees the measured sizes
    and rebalances them: an hour is cut into as many parts of the advisory size as it needs, and quiet
    hours are put together. Unlike a range partitioning this does not run the input twice to find its
    bounds, so raw text is parsed once.

    With mode "append" the row ids go on after those of the table, so they stay unique.
    """
    if mode == "append":
        df = df.withColumn("event_id", F.col("event_id") + F.lit(next_event_id(df.sparkSession, path)))
    by_hour = df.withColumn("_hour", F.date_trunc("hour", "ts"))
    spread = by_hour.hint("rebalance", partitions, "_hour") if partitions else by_hour.hint("rebalance", "_hour")
    (
        spread.drop("_hour").withColumn(DAY, F.to_date("ts")).sortWithinPartitions(DAY, "ts", "event_id")
        .write.mode(mode).option("compression", "zstd").partitionBy(DAY).parquet(path)
    )


def next_event_id(spark: SparkSession, path: str) -> int:
    """One more than the largest row id of the table, or 0 if there is no table yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return table.agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).first()[0]


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a derived table (sample, features, train, test) as ZSTD Parquet."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def in_window(df: DataFrame, start, end) -> DataFrame:
    """Rows with `ts` in `[start, end)`; prunes day folders where the table has them."""
    return _in_days(df.filter(within(F.col("ts"), start, end)), start, end)


def between(df: DataFrame, low, high) -> DataFrame:
    """Rows with `ts` from `low` to `high`, both ends in, with the same folder pruning."""
    return _in_days(df.filter(F.col("ts").between(instant(low), instant(high))), low, high)


def during(df: DataFrame, unit: str, moment) -> DataFrame:
    """Rows with `date_trunc(unit, ts) = moment`, with the same folder pruning."""
    return _in_days(df.filter(in_unit(F.col("ts"), unit, moment)), moment, unit_end(unit, moment))


def _in_days(df: DataFrame, start, end) -> DataFrame:
    if DAY in df.columns:
        return df.filter(F.col(DAY).between(F.to_date(instant(start)), F.to_date(instant(end))))
    return df


def before(df: DataFrame, end) -> DataFrame:
    """Rows with `ts` earlier than `end`, with the same folder pruning."""
    kept = df.filter(F.col("ts") < instant(end))
    if DAY in df.columns:
        kept = kept.filter(F.col(DAY) <= F.to_date(instant(end)))
    return kept
