"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only if it has been counted to be at most this
# long. All sides this is used on are narrow (row ids or a few numbers), so the
# bound is on the order of 100 MB per executor.
BROADCAST_ROWS = 1_000_000

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only where that is unset, and only on a single machine, a temporary folder
    is used instead, and removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="muralog-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return _own_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner
    the true size of the table, so that it can choose joins by it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, label: str) -> DataFrame:
    """Stage the small side of a join and let its counted length decide how it is joined.

    Without this the planner only learns the size of a computed side after the
    large side has been shuffled as well.
    """
    return broadcast_if_small(stage(df, label))


def broadcast_if_small(staged: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if its counted length allows it.

    The count comes from the file footers. Above the bound the table is returned
    unmarked: the join then shuffles, and adaptive execution splits its skewed
    partitions.
    """
    return F.broadcast(staged) if staged.count() <= max_rows else staged
