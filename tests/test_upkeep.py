"""Stored sessions and user bounds that batches are merged into."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from muralog.operators import sessions
from muralog.sources import upkeep

GAP = 600


def whole(events):
    at_once = sessions.sessions(events.filter("user_id IS NOT NULL AND ts IS NOT NULL"), GAP)
    return sorted(tuple(r) for r in at_once.select("user_id", "session_id", "start_ts", "end_ts", "events").collect())


def stored(spark, path):
    return sorted(tuple(r) for r in upkeep.stored_sessions(spark, path).select("user_id", "session_id", "start_ts", "end_ts", "events").collect())


@pytest.mark.parametrize("parts", ["hour(ts) < 9", "event_id % 2 = 0", "hour(ts) >= 20", "event_id < 0", "user_id = 7"])
def test_two_batches_are_one(spark, skewed, tmp_path, parts):
    """In time order, interleaved, late, empty, and a whole user in one batch."""
    path = str(tmp_path / "store")
    for keep in (parts, f"NOT ({parts})"):
        upkeep.append_batch(skewed.filter(keep), path, GAP)
    assert stored(spark, path) == whole(skewed)
    bounds = sorted(tuple(r) for r in upkeep.stored_users(spark, path).collect())
    assert bounds == sorted(tuple(r) for r in skewed.groupBy("user_id").agg(F.min("ts"), F.max("ts"), F.count("*")).collect())


def test_many_small_batches_in_any_order(spark, place, tmp_path):
    """Late rows prolong, bridge and precede sessions; pauses are the gap, a microsecond less and more."""
    rng, rows = random.Random(3), []
    for user in (1, 2, 3):
        at = 0
        for _ in range(12):
            at += rng.choice([1, GAP * 1_000_000 - 1, GAP * 1_000_000, GAP * 1_000_000 + 1, 5_000_000_000])
            rows.append((len(rows), user, at))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, user_id long, at long").withColumn("ts", F.timestamp_micros(F.col("at") + 1_700_000_000_000_000))
    path = str(tmp_path / "store")
    for k in range(0, len(rows), 9):
        upkeep.append_batch(events.filter(F.col("event_id").isin([r[0] for r in rows[k:k + 9]])), path, GAP)
    assert stored(spark, path) == whole(events)


def test_only_touched_users_are_written(spark, skewed, tmp_path):
    path = str(tmp_path / "store")
    upkeep.append_batch(skewed.filter("hour(ts) < 12"), path, GAP)
    batch = skewed.filter("hour(ts) >= 12 AND user_id IN (3, 4, 5)")
    gen = upkeep.append_batch(batch, path, GAP)
    for table in ("sessions", "users"):
        users = {r.user_id for r in spark.read.parquet(f"{path}/{table}/gen={gen}").select("user_id").distinct().collect()}
        assert users == {r.user_id for r in batch.select("user_id").distinct().collect()}
    assert stored(spark, path) == whole(skewed.filter("hour(ts) < 12 OR user_id IN (3, 4, 5)"))
    upkeep.compact(spark, path, f"{path}-compact")
    assert stored(spark, f"{path}-compact") == stored(spark, path)


def test_a_broken_batch_changes_nothing(spark, skewed, tmp_path, monkeypatch):
    """Sessions were written, users were not: the store is as before, and the batch can be merged again."""
    path = str(tmp_path / "store")
    upkeep.append_batch(skewed.filter("event_id % 2 = 0"), path, GAP)
    before = stored(spark, path)
    upkeep.append_batch(skewed.filter("event_id % 2 = 1"), path, GAP)
    after = stored(spark, path)
    import shutil

    shutil.rmtree(f"{path}/users/gen=1")
    assert stored(spark, path) == before
    assert upkeep.append_batch(skewed.filter("event_id % 2 = 1"), path, GAP) == 1
    assert stored(spark, path) == after


def test_odd_rows(spark, place, tmp_path):
    path = str(tmp_path / "store")
    assert upkeep.stored_sessions(spark, path).collect() == [] and upkeep.stored_users(spark, path).collect() == []
    odd = place([(1, None, 1, "a", 0, 0), (2, "2024-01-01", None, "a", 0, 0), (3, "2024-01-01", 5, "a", 0, 0), (3, "2024-01-01", 5, "a", 0, 0)]).withColumns(
        {c: F.lit("extra") for c in ("gen", "start_ts", "events", "_opens")})
    upkeep.append_batch(odd, path, GAP)
    upkeep.append_batch(odd.limit(0), path, GAP)
    assert [(r.user_id, r.session_id, r.events, r.session_length_min) for r in upkeep.stored_sessions(spark, path).collect()] == [(5, 1, 2, 0)]
    with pytest.raises(ValueError):
        upkeep.append_batch(odd, path, GAP + 1)
