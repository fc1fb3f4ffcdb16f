from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from muralog.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def events(spark, sf_dir):
    """The placements of the test data, written once."""
    from checks import fixture as fx
    from muralog.sources.scratch import stage

    return stage(fx.placements(spark, sf_dir), "test-placements")


@pytest.fixture(scope="session")
def place(spark):
    """Build a placement table from short rows: `place([(id, ts, user, pc, x, y), ...])`."""
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, pc string, x int, y int")
        return df.withColumn("ts", F.to_timestamp("ts"))

    return build


@pytest.fixture(scope="session")
def skewed(spark):
    """3000 placements; one user, one pixel and one grid cell hold a third of them, with ties in time."""
    from pyspark.sql import functions as F

    from muralog.sources.scratch import stage

    n = F.col("event_id")
    hot = n % 3 == 0
    spread = F.pmod(F.xxhash64(n), F.lit(86_400)).cast("long")
    return stage(spark.range(3000).withColumnRenamed("id", "event_id").select(
        "event_id",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.when(hot, spread - spread % 60).otherwise(spread)).alias("ts"),
        F.when(hot, F.lit(7)).otherwise(F.pmod(F.xxhash64(n, F.lit(1)), F.lit(200))).cast("long").alias("user_id"),
        F.element_at(F.array(*[F.lit(c) for c in ("#000000", "#FFFFFF", "#FF4500")]),
                     (F.pmod(F.xxhash64(n, F.lit(2)), F.lit(3)) + 1).cast("int")).alias("pc"),
        F.when(hot, F.lit(5)).otherwise(F.pmod(F.xxhash64(n, F.lit(3)), F.lit(40))).cast("int").alias("x"),
        F.when(hot, F.lit(5)).otherwise(F.pmod(F.xxhash64(n, F.lit(4)), F.lit(40))).cast("int").alias("y"),
    ), "skewed")
