"""Pixels, users or other keys with many rows, found without grouping by all keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

# Counters of a task.
MOST_COUNTERS = 2_000_000


def merge_counters(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: counters of the keys seen so far, with a batch of further keys, at most `capacity` of them.

    What the largest counter that has no room holds is taken from all, so a key loses at most
    (rows / (capacity + 1)) in all and every more frequent one keeps a counter.
    """
    new, n = np.unique(more, return_counts=True)
    found, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    total = np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)
    if len(found) > capacity:
        total -= np.partition(total, len(total) - capacity - 1)[len(total) - capacity - 1]
        found, total = found[total > 0], total[total > 0]
    return found, total


def candidates(df: DataFrame, keys: Sequence[str], min_rows: int, rows: int) -> DataFrame:
    """`_key` hashes that hold every key with more than `min_rows` rows, and at most rows / min_rows of each task.

    A task keeps as many counters as keys can exceed the bound. A key that no task has a counter for has
    lost at most rows_of_task / (counters + 1) in each, which is at most `min_rows` in all.
    """
    capacity = max(1, -(-rows // max(min_rows, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held, counts = merge_counters(held, counts, np.asarray(batch.column("_key")), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["_key"])

    return df.select(F.xxhash64(*keys).alias("_key")).mapInArrow(run, "_key long").distinct()


def heavy_hitters(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """`<keys>, n` for every key with more than `min_rows` rows, exactly; NULL is a key.

    The first pass keeps a few counters per task in place of a row per key, the second counts only the
    candidates it left. Use it where few of very many keys are asked for: the state of the grouping and
    the shuffle are bounded by rows / min_rows, not by the number of keys. Where that bound is itself beyond
    `MOST_COUNTERS` all keys are counted.
    """
    rows = df.count()
    if rows > MOST_COUNTERS * max(min_rows, 1):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)
    found = broadcast_if_small(stage(candidates(df, keys, min_rows, rows), "candidates"))
    kept = df.select(*keys).withColumn("_key", F.xxhash64(*keys)).join(found, "_key", "left_semi")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)
