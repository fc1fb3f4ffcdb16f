from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from muralog.functions.keys import sample_key
from muralog.operators import sampling


def ids(df):
    return {r[0] for r in df.select("event_id").collect()}


def test_one_instant_is_one_bin(place):
    p = place([(i, "2024-01-01 00:00:00", i, "a", 0, 0) for i in range(5)])
    assert [r.time_bin for r in sampling.with_time_bin(p).collect()] == [0] * 5
    assert sampling.stratified_time_sample(p, 24, 48).count() == 2


def test_rows_without_time_are_not_sampled(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, None, 1, "a", 0, 0)])
    assert ids(sampling.with_time_bin(p)) == {1}


def test_quota_per_bin_is_exact(events):
    sizes = dict(sampling.with_time_bin(events, 24).groupBy("time_bin").count().collect())
    sample = sampling.stratified_time_sample(events, 24, 24 * 415)
    got = dict(sampling.with_time_bin(events, 24).join(sample.select("event_id"), "event_id").groupBy("time_bin").count().collect())
    assert got == {b: min(415, n) for b, n in sizes.items()}


@pytest.mark.parametrize("n", [0, 1, 700, 2999, 3000, 5000])
def test_uniform_sample_is_the_lowest_keys(skewed, n):
    w = Window.orderBy(sample_key("event_id", 9), "event_id")
    want = ids(skewed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n))
    assert ids(sampling.uniform_sample(skewed, n, 9)) == want
    assert len(want) == min(n, 3000)


def test_a_misjudged_margin_is_widened(skewed, monkeypatch):
    want = ids(sampling.uniform_sample(skewed, 500, 9))
    monkeypatch.setattr(sampling, "_margin", lambda n: 0.5)
    assert ids(sampling.uniform_sample(skewed, 500, 9)) == want


def test_ids_that_cannot_be_drawn_by_are_refused(skewed, place):
    with pytest.raises(ValueError):
        sampling.uniform_sample(place([(None, "2024-01-01 00:00:00", 1, "a", 0, 0)] * 3), 1)
    with pytest.raises(ValueError):
        sampling.uniform_sample(skewed.sparkSession.range(2_000_000).selectExpr("7L as event_id"), 10)


def test_repeated_ids_at_the_cut_are_refused(place):
    with pytest.raises(ValueError):
        sampling.temporal_split(place([(i % 3, "2024-01-01 00:00:00", 1, "a", 0, 0) for i in range(100)]))


def test_sample_does_not_depend_on_partitioning(events):
    a = ids(sampling.stratified_time_sample(events, 24, 2400))
    b = ids(sampling.stratified_time_sample(events.repartition(13), 24, 2400))
    assert a == b and len(a) == 2400 and sum(a) == 12005538


@pytest.mark.parametrize("rows, train", [(12, 10), (10, 8), (3, 3), (4, 4), (1, 1), (0, 0)])
def test_earlier_folds_are_longer(place, rows, train):
    p = place([(i, f"2024-01-01 00:00:{i:02d}", 1, "a", 0, 0) for i in range(rows)]) if rows else place(
        [(1, "2024-01-01 00:00:00", 1, "a", 0, 0)]).filter("false")
    first, last = sampling.temporal_split(p)
    assert (first.count(), last.count()) == (train, rows - train)
    assert not ids(first) & ids(last)


def test_cut_is_found_in_steps_and_through_ties(skewed):
    ordered = [(r[0], r[1]) for r in skewed.select(F.unix_micros("ts"), "event_id").orderBy("ts", "event_id").collect()]
    for position in (1, 2, 999, 1500, 2400, 3000):
        assert sampling.key_at(skewed, position, 3000, buckets=7, enough=5) == ordered[position - 1]
    one_instant = skewed.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert sampling.key_at(one_instant, 1234, 3000, buckets=7, enough=5)[1] == 1233


def test_split_is_a_filter(events):
    train, test = sampling.temporal_split(events)
    for part in (train, test):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert "LessThanOrEqual(ts" in train._jdf.queryExecution().executedPlan().toString()
    assert train.agg(F.max("ts")).first()[0] <= test.agg(F.min("ts")).first()[0]


def test_split_needs_time_and_id(place):
    with pytest.raises(ValueError):
        sampling.temporal_split(place([(i, None if i == 3 else "2024-01-01 00:00:00", 1, "a", 0, 0) for i in range(10)]))


def test_midpoint_slice_is_half_open(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 05:00:00", 1, "a", 0, 0),
               (3, "2024-01-01 08:00:00", 1, "a", 0, 0), (4, "2024-01-01 10:00:00", 1, "a", 0, 0)])
    assert ids(sampling.midpoint_slice(p, 180)) == {2}
    assert ids(sampling.midpoint_slice(p, 180.5)) == {2, 3}
