from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from muralog.functions.bins import left_closed_bin, right_closed_bin
from muralog.functions.clock import crossed_minutes, crossed_seconds, in_unit, seconds_between, slot_start
from muralog.functions.keys import key_mark, key_up_to, sample_key
from muralog.operators import charts


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_boundaries_are_counted_not_elapsed_time(spark):
    span = {"a": ts("2024-01-01 00:00:59"), "b": ts("2024-01-01 00:01:01")}
    assert one(spark, crossed_minutes("a", "b"), **span) == 1
    span = {"a": ts("2024-01-01 00:00:00.9"), "b": ts("2024-01-01 00:00:01.1")}
    assert one(spark, crossed_seconds("a", "b"), **span) == 1
    assert one(spark, seconds_between("a", "b"), **span) == pytest.approx(0.2)
    assert one(spark, crossed_minutes("a", "b"), a=ts("1969-12-31 23:59:59"), b=ts("1970-01-01 00:00:00")) == 1


def test_slots_have_one_width_on_both_sides_of_the_epoch(spark):
    assert one(spark, slot_start("a", 10_000_000), a=ts("1969-12-31 23:59:59")) == -10_000_000
    assert one(spark, slot_start("a", 10_000_000), a=ts("1970-01-01 00:00:09")) == 0


def test_unit_test_equals_truncation(spark, events):
    for moment in ("2024-01-01 00:00:00", "2024-01-01 00:30:00"):
        want = events.filter(F.date_trunc("hour", "ts") == ts(moment)).count()
        assert events.filter(in_unit(F.col("ts"), "hour", moment)).count() == want
    plan = events.filter(in_unit(F.col("ts"), "hour", "2024-01-01"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_right_closed_bins_follow_pandas_cut(spark):
    for values, bins in (([0, 1, 2, 3, 10, 39], 12), ([3.5, 3.75, 8.0, 9.25], 5), ([4, 4, 4], 120), ([4, 4], 5)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ends = charts.extent(df, ["v"])
        got = [r[0] for r in df.select(right_closed_bin(F.col("v"), ends["lo_v"], ends["hi_v"], bins)).collect()]
        assert got == pd.cut(pd.Series(values, dtype=float), bins=bins, labels=False).tolist()


def test_left_closed_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2.4, 2.5, 9.9, 10)], "v double")
    got = [r[0] for r in df.select(left_closed_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 4)).collect()]
    assert got == [0, 0, 1, 3, 3]


def test_histogram_counts_every_value(spark, events):
    h = charts.histogram(events.select(F.col("x").cast("double").alias("v")), "v", 30).collect()
    assert sum(r.n for r in h) == events.count()
    values = spark.createDataFrame([(v,) for v in (0.0, 0.0, 1.0, 10.0, 1000.0, None)], "v double")
    rows = {r.bin: r for r in charts.histogram(values, "v", 3, log10=True).collect()}
    assert {b: r.n for b, r in rows.items()} == {-1: 2, 0: 1, 1: 1, 2: 1}
    assert rows[-1].bin_low is None and rows[1].bin_low == pytest.approx(10.0)


def test_empty_input_gives_empty_charts(spark, events):
    none = events.filter("false")
    assert charts.histogram(none.select(F.col("x").alias("v")), "v", 10).count() == 0
    assert charts.bin2d(none, 10).count() == 0


def test_sampling_keys_are_even(spark):
    keys = spark.range(20_000).select(sample_key("id", 3).alias("k"))
    below = keys.filter(key_up_to(F.col("k"), key_mark(0.1))).count()
    assert abs(below - 2000) < 5 * 43
    assert keys.filter(key_up_to(F.col("k"), key_mark(1.0))).count() == 20_000
