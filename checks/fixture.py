"""The `events` table seen as a placement log, and parameters that suit its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muralog.session import configure
from muralog.sources.placements import as_placements

# Event types stand for colours. `purchase` maps to a code outside the palette,
# so that the group without a name is exercised.
COLORS = {"signup": "#000000", "error": "#FF4500", "click": "#FFFFFF", "view": "#2450A4", "purchase": "#123456"}

WINDOW = ("2024-01-08", "2024-01-15")
FIRST_WINDOW = ("2024-01-01 06:00:00", "2024-01-01 18:00:00")
SESSION_GAP = 240 * 60
CHURN, HOT, HOTTEST = 10, 20, 25
TOP_USERS = 50
LOW_DIVERSITY = {"min_edits": 60, "max_colors": 5}
SPIKE, UNIT = "2024-01-01 00:00:00", "hour"
RANGE = ("2024-01-03 20:30:00", "2024-01-05 21:30:00")
HOURS = ("2024-01-03 20:00:00", "2024-01-20 07:00:00")
SHORT, LONG = 42500, 42900
N_BINS, N_TOTAL, SEED = 24, 2400, 42
N_ASKED = 300
SURVIVE_MINUTES, GRID, LOOKBACK_MINUTES = 2880, 10, 1440


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    color = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, code in COLORS.items():
        color = color.when(F.col("event_type") == kind, code)
    return as_placements(events.select(
        "event_id", "ts", "user_id", color.alias("pc"),
        F.least(F.floor(F.col("value") / 4), F.lit(39)).cast("int").alias("x"),
        (F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int") % 40).alias("y"),
    ))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same placements as raw text, in the shape of the published log."""
    p = placements(spark, sf_dir)
    return p.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("pc").alias("pixel_color"),
        F.concat_ws(",", "x", "y").alias("coordinate"),
    )


def comparable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and doubles rounded to 6 places, for comparison across engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)
