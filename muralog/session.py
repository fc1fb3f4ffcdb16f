"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

MIB = 1024 * 1024

# Plain Spark SQL settings. UTC keeps `date_trunc` and `unix_*` free of zone
# shifts; adaptive execution merges small shuffle partitions, splits skewed join
# partitions and turns a shuffled join into a broadcast one once the measured
# size of a side allows it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built.

    `shuffled_bytes` is the size of the largest shuffle to expect; when given,
    the number of shuffle partitions is set from it.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if shuffled_bytes is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions(shuffled_bytes)))
    return spark


def shuffle_partitions(shuffled_bytes: int, partition_bytes: int = 256 * MIB,
                       at_least: int = 8, at_most: int = 40_000) -> int:
    """Shuffle partitions for `shuffled_bytes` of data.

    Aims at partitions that sort in memory; adaptive execution merges the small
    ones, so the upper side is the safe side to err on.
    """
    wanted = -(-shuffled_bytes // partition_bytes)
    return max(at_least, min(at_most, wanted))


def local_session(cores: int | str = "*", app: str = "muralog", partitions: int = 8) -> SparkSession:
    """A single-machine session, as used by the tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())
