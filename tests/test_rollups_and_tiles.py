"""Sketches, heavy hitters, tile pyramids and running baselines against plain computation."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralog.operators import heavy, rollups, spikes, tiles
from muralog.sources.scratch import stage


def test_distinct_users_of_any_window(spark):
    """Windows of all lengths from one rollup; the error of merged sketches is that of one."""
    df = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 36_000).alias("ts"), F.when(F.col("id") % 1000 != 0, F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("user_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("pc"))
    stored = stage(rollups.activity_rollup(df), "rollup")
    assert stored.count() == 600 * 3
    for start, end in (("2024-01-01 00:00", "2024-01-01 00:01"), ("2024-01-01 02:30", "2024-01-01 07:17"), ("2024-01-01", "2024-01-02")):
        inside = df.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        exact = {r.pc: (r.n, r.u) for r in inside.groupBy("pc").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u")).collect()}
        asked = rollups.distinct_users(stored, start, end, ["pc"])
        got = {r.pc: (r.placements, r.users) for r in asked.collect()}
        assert set(got) == set(exact) and all(got[k][0] == exact[k][0] and abs(got[k][1] - exact[k][1]) <= 4 * rollups.DISTINCT_ERROR * exact[k][1] + 1 for k in exact)
        total = rollups.distinct_users(stored, start, end).first()
        assert abs(total.users - inside.agg(F.count_distinct("user_id")).first()[0]) <= 4 * rollups.DISTINCT_ERROR * total.users + 1
    nothing = rollups.distinct_users(stored, "2030-01-01", "2030-01-02").collect()
    assert [(r.placements, r.users) for r in nothing] == [(0, 0)]
    # The question reads the rollup alone.
    assert len(rollups.distinct_users(stored, "2024-01-01", "2024-01-02").inputFiles()) == len(stored.inputFiles())


@pytest.mark.parametrize("shape", ["even", "skewed", "ties"])
def test_percentiles_are_within_the_rank_error(spark, shape):
    value = {"even": F.col("id") % 9973, "skewed": F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 50.0), "ties": F.col("id") % 5}[shape].cast("double")
    df = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7).alias("ts"), F.when(F.col("id") % 100 != 1, value).alias("v"), (F.col("id") % 2).alias("g"))
    stored = stage(rollups.value_rollup(df, "v", by=["g"]), "values")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for start, end in ((None, None), ("2024-01-02", "2024-01-03 05:00")):
        inside = df if start is None else df.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        values = {g: np.sort([r.v for r in inside.filter(f"g = {g} AND v IS NOT NULL").collect()]) for g in (0, 1)}
        for r in rollups.percentiles(stored, shares, start, end, ["g"]).collect():
            ordered = values[r.g]
            assert r.n == len(ordered)
            low, high = np.searchsorted(ordered, r.value, "left") / r.n, np.searchsorted(ordered, r.value, "right") / r.n
            assert low - rollups.RANK_ERROR <= r.percentile <= high + rollups.RANK_ERROR
    assert rollups.percentiles(stored, shares, "2030-01-01", "2030-01-02").collect() == []


def test_counters_are_bounded_and_lose_no_heavy_key():
    rng = random.Random(2)
    for capacity in (1, 5, 40):
        keys = [rng.choice([7, 7, 8, rng.randrange(10_000)]) for _ in range(20_000)]
        held, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(keys):
            n = rng.randrange(1, 700)
            held, counts = heavy.merge_counters(held, counts, np.array(keys[at:at + n]), capacity)
            assert len(held) <= capacity
            at += n
        true = Counter(keys)
        assert {k for k, n in true.items() if n > len(keys) / (capacity + 1)} <= set(held.tolist())
        assert all(true[k] - len(keys) / (capacity + 1) <= n <= true[k] for k, n in zip(held.tolist(), counts.tolist()))


@pytest.mark.parametrize("bound", [1, 3, 20, 999, 1000, 5000])
def test_heavy_hitters_are_exact(spark, bound, monkeypatch):
    """A key with a third of the rows, NULL keys, a long tail; also where all keys have to be counted."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 10 != 1, F.pmod(F.xxhash64("id"), F.lit(900))).alias("a"), (F.col("id") % 3).alias("b")).repartition(6)
    want = {(r.a, r.b): r["count"] for r in df.groupBy("a", "b").count().filter(F.col("count") > bound).collect()}
    for most in (heavy.MOST_COUNTERS, 2):
        monkeypatch.setattr(heavy, "MOST_COUNTERS", most)
        assert {(r.a, r.b): r.n for r in heavy.heavy_hitters(df, ["a", "b"], bound).collect()} == want
    # What comes out of the first pass is bounded by rows / bound in each task.
    assert heavy.candidates(df, ["a", "b"], bound, 3000).count() <= 6 * -(-3000 // bound)
    assert heavy.heavy_hitters(df.limit(0), ["a", "b"], bound).collect() == []


def test_keys_interleave(spark):
    places = spark.createDataFrame([(x, y) for x in (0, 1, 2, 5, 1999, 65_535) for y in (0, 1, 3, 1000, 65_535)], "x int, y int")
    key = tiles.morton(F.col("x"), F.col("y"))
    x, y = tiles.unmorton(F.col("k"))
    for r in places.withColumn("k", key).withColumns({"bx": x, "by": y}).collect():
        assert (r.bx, r.by) == (r.x, r.y) and r.k == sum(((r.x >> i & 1) | (r.y >> i & 1) << 1) << 2 * i for i in range(16))


def test_tiles_are_those_of_each_level(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(300), rng.randrange(2000) if rng.random() < 0.7 else 5, rng.choice([None, 1, 2]), rng.choice("ab")) for _ in range(800)] + [(None, 1, 1, "a"), (1, None, 1, "b")]
    df = spark.createDataFrame(rows, "x int, y int, v long, f string").withColumn("level", F.lit("clash"))
    got = {(r.f, r.level, r.x_tile, r.y_tile): (r.n, r.total) for r in tiles.tile_pyramid(df, 12, "v", ["f"]).collect()}
    want = {}
    for x, y, v, f in rows:
        if x is not None and y is not None:
            for level in range(12):
                n, total = want.get(key := (f, level, x >> level, y >> level), (0, None))
                want[key] = (n + 1, total if v is None else v + (total or 0))
    assert got == want
    assert tiles.tile_pyramid(df.limit(0)).collect() == []


def plain_baseline(rows, periods, least):
    out, seen = {}, {}
    for slot, n in rows:
        before = seen.setdefault(slot % 24, [])
        last = before[-periods:]
        if len(last) >= least:
            m = median(last)
            mad = median(abs(v - m) for v in last)
            out[slot] = (m, mad, (n - m) / ((mad or 1) * 1.4826))
        else:
            out[slot] = (None, None, None)
        before.append(n)
    return out


def test_a_spike_does_not_raise_its_own_baseline(spark):
    rng = random.Random(5)
    rows = [(h, 100 + h % 24 * 10 + rng.randrange(5)) for h in range(24 * 30) if rng.random() < 0.95]
    rows = [(h, n * 50 if h == 24 * 20 + 7 else n) for h, n in rows if h != 24 * 21 + 7] + [(24 * 21 + 7, 9000)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "h long, n long").select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("h") * 3600).alias("minute"), "h", "n")
    got = {r.h: r for r in spikes.running_baseline(df, "n", unit_seconds=3600, periods=10, least=4).collect()}
    for h, (m, mad, score) in plain_baseline(rows, 10, 4).items():
        r = got[h]
        assert (r.median, r.mad) == (m, mad) and (score is None) == (r.score is None) and (score is None or abs(r.score - score) < 1e-9)
    # Neither the spike nor the one a day later, which the first one does not hide.
    assert got[24 * 21 + 7].score > 100 and abs(got[24 * 21 + 7].median - 172) < 5
    assert max(r.score for h, r in got.items() if r.score is not None and r.n < 1000) < 8
