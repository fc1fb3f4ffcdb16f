"""The raw placement log: CSV with a header, one row per placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muralog.functions.keys import user_key

RAW_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("pixel_color", T.StringType()),
    T.StructField("coordinate", T.StringType()),
])


def read_raw_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read the raw log with a given schema: no inference pass, and bad rows stop the job.

    The columns may be in any order, which the header gives. All files of one call must have
    the same header: Spark checks each against the first one's, and a file that differs stops
    the job instead of being read with its columns swapped. Read such files on their own.
    """
    probe = spark.read.option("header", True).csv(path)
    order = {name: i for i, name in enumerate(probe.columns)}
    missing = [f.name for f in RAW_SCHEMA if f.name not in order]
    if missing:
        raise ValueError(f"raw log lacks the columns {missing}")
    fields = {f.name: f for f in RAW_SCHEMA}
    schema = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in probe.columns])
    return (
        spark.read.schema(schema)
        .options(header=True, mode="FAILFAST", enforceSchema=False)
        .csv(path)
        .select(*[f.name for f in RAW_SCHEMA])
    )


def ingest_placements(raw: DataFrame) -> DataFrame:
    """Raw log → placements `(event_id, ts, user_id, pc, x, y)`.

    A narrow projection, so it runs at scan speed. `event_id` is a row id that
    later steps use to break ties and to join back without fan-out; it keeps its
    meaning once the result has been written.
    """
    return raw.select(
        F.monotonically_increasing_id().alias("event_id"),
        F.col("timestamp").alias("ts"),
        user_key("user_id").alias("user_id"),
        F.col("pixel_color").alias("pc"),
        _part("coordinate", 1).alias("x"),
        _part("coordinate", 2).alias("y"),
    )


def _part(column: str, number: int) -> Column:
    text = F.split_part(F.col(column), F.lit(","), F.lit(number))
    value = text.try_cast("int")
    complaint = F.raise_error(F.concat(F.lit("not a coordinate: "), F.col(column))).cast("int")
    return F.when(value.isNull() & F.col(column).isNotNull(), complaint).otherwise(value)
