"""Rules that the test data does not reach, on small hand-made tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from muralog.operators import activity, baseline, charts, churn, diversity, evaluation, newcomers, sampling, sessions
from muralog.operators.neighbours import heavy_keys, heavy_pieces, with_neighbours
from muralog.plans import reports
from muralog.sources.placements import read_placements, write_placements
from muralog.sources.scratch import stage


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_gap_on_the_limit_stays_in_the_session(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:15:00", 1, "a", 0, 0),
               (3, "2024-01-01 00:30:00.000001", 1, "a", 0, 0)])
    got = rows(sessions.sessions(p, 15 * 60).orderBy("session_id"), "session_id", "events")
    assert got == [(1, 2), (2, 1)]


def test_single_placements_are_left_out_of_the_mean_but_single_sessions_are_not(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:01:40", 1, "a", 0, 0),
               (3, "2024-01-01 05:00:00", 1, "a", 0, 0), (4, "2024-01-01 00:00:00", 2, "a", 0, 0)])
    assert sessions.avg_session_length(p, "2024-01-01", "2024-01-02").first()[0] == pytest.approx(50.0)


def test_sessions_of_a_busy_user_equal_the_plain_definition(skewed):
    for gap in (30, 61, 600):
        w = Window.partitionBy("user_id").orderBy("ts")
        opens = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) <= gap * 1_000_000, 0).otherwise(1)
        plain = (
            skewed.withColumn("o", opens).withColumn("session_id", F.sum("o").over(w))
            .groupBy("user_id", "session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"))
        )
        ours = sessions.sessions(skewed, gap)
        assert ours.count() == plain.count() and ours.exceptAll(plain).isEmpty()


def test_sessions_partition_the_events(events):
    assert sessions.sessions(events, 240 * 60).agg(F.sum("events")).first()[0] == events.count()


@pytest.mark.parametrize("key", [["user_id"], ["x", "y"]])
@pytest.mark.parametrize("target", [10, 100, 10**6])
def test_neighbours_do_not_depend_on_how_a_key_is_cut(skewed, key, target):
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    plain = skewed.select("*", F.lag("ts").over(w).alias("prev_ts"), F.lead("ts").over(w).alias("next_ts"),
                          (F.row_number().over(w) - 1).cast("long").alias("earlier_rows"))
    ours = with_neighbours(skewed, key, target_rows=target)
    assert ours.columns == plain.columns and ours.count() == 3000
    assert ours.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("ts", ["burst", "instant"])
@pytest.mark.parametrize("user", ["7", "NULL"])
def test_no_piece_of_a_heavy_key_is_long(spark, ts, user):
    """One key holds nearly all rows within seconds, or in one instant; it may be NULL."""
    at = "timestamp_micros(1704067200000000 + if(id < 19990, id % 20000000, id * 1000000))" if ts == "burst" else "timestamp'2024-01-01'"
    df = stage(spark.range(20_000).selectExpr("id as event_id", f"{at} as ts", f"if(id % 10 = 0, id, {user}) as user_id"), "burst")
    heavy = stage(heavy_keys(df, ["user_id"], 1000), "heavy")
    assert [tuple(r) for r in heavy.collect()] == [(None if user == "NULL" else 7, 18_000)]
    pieces = heavy_pieces(df, heavy, ["user_id"], 1000)
    sizes = [r["count"] for r in pieces.groupBy("_piece").count().collect()]
    assert sum(sizes) == 18_000 and max(sizes) <= 2000
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = df.select("*", F.lag("ts").over(w).alias("prev_ts"), F.lead("ts").over(w).alias("next_ts"),
                      (F.row_number().over(w) - 1).cast("long").alias("earlier_rows"))
    ours = with_neighbours(df, ["user_id"], target_rows=1000)
    assert ours.count() == 20_000 and ours.exceptAll(plain).isEmpty()


@pytest.fixture(scope="module")
def by_day(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by-day") / "placements")
    write_placements(events, path)
    return read_placements(events.sparkSession, path)


@pytest.mark.parametrize("name, run", [
    ("activity_in_range", lambda p: activity.activity_in_range(p, "2024-01-03 20:30:00", "2024-01-05 21:30:00")),
    ("minute_heatmap", lambda p: activity.minute_heatmap(p, "2024-01-03 20:00:00", "hour")),
    ("spike_first_time_users", lambda p: newcomers.spike_first_time_users(p, "2024-01-03 20:00:00", "hour")),
    ("midpoint_slice", sampling.midpoint_slice),
])
def test_time_filters_prune_day_folders(by_day, name, run):
    plan = run(by_day)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "event_date#" in x]
    assert scans and all("PartitionFilters: [isnotnull(event_date" in x for x in scans)


def test_other_classes_are_counted(spark):
    pred = spark.sql("SELECT * FROM VALUES (0, 0), (2, 2), (1, 2), (NULL, 1) AS t(y, prediction)")
    matrix = evaluation.confusion_matrix(pred, "y")
    assert matrix.columns == ["label", "predicted_0", "predicted_1", "predicted_2", "predicted_null"]
    assert {tuple(r) for r in matrix.collect()} == {(0, 1, 0, 0, 0), (1, 0, 0, 1, 0), (2, 0, 0, 1, 0), (None, 0, 1, 0, 0)}


def test_unknown_colours_form_one_group(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "#FFFFFF", 0, 0), (2, "2024-01-01 00:00:01", 1, "#123456", 0, 0),
               (3, "2024-01-01 00:00:02", 1, "#654321", 0, 0), (4, "2024-01-01 00:00:02", 2, None, 0, 0)])
    assert rows(baseline.color_rank(p, "2024-01-01", "2024-01-02"), "position", "color", "user_count") == [
        (1, None, 2), (2, "White", 1)]


def test_windows_are_half_open(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "#FFFFFF", 0, 0), (2, "2024-01-02 00:00:00", 2, "#FFFFFF", 0, 0)])
    assert baseline.first_time_users(p, "2024-01-01", "2024-01-02").first()[0] == 1
    assert baseline.color_rank(p, "2024-01-01", "2024-01-02").first().user_count == 1
    with pytest.raises(ValueError):
        reports.baseline_report(p, "2024-01-02", "2024-01-02")


def test_first_time_users_look_at_all_earlier_placements(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-02 00:00:00", 1, "a", 0, 0)])
    assert baseline.first_time_users(p, "2024-01-02", "2024-01-03").first()[0] == 0


def test_focus_is_zero_without_hot_edits(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:00:01", 2, "a", 1, 1)])
    hot = churn.hot_pixels(p, 5)
    users = p.select("user_id").distinct()
    assert rows(churn.hot_edit_focus(p, users, hot), "hot_edits", "hot_edit_ratio") == [(0, 0.0), (0, 0.0)]


def test_colour_count_leaves_null_out(place):
    p = place([(1, "2024-01-01 00:00:00", 1, None, 0, 0), (2, "2024-01-01 00:00:01", 1, "a", 0, 0),
               (3, "2024-01-01 00:00:01", 1, None, 0, 0)])
    r = diversity.color_use(p).first()
    assert (r.total_colors, r.total_edits, r.top_color_edits) == (1, 3, 2)


def test_empty_cohort_gives_no_placements(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 05:00:00", 1, "a", 0, 0)])
    spans = newcomers.spike_lifespans(p, "2024-01-01 00:00:00")
    assert spans.count() == 1
    assert newcomers.lifespan_cohort_placements(p, spans, max_minutes=5).count() == 0
    assert newcomers.lifespan_cohort_placements(p, spans, min_minutes=300).count() == 2
    assert charts.bin2d(newcomers.lifespan_cohort_placements(p, spans, max_minutes=5), 100).count() == 0


def test_spike_users_are_the_same_from_shared_bounds(events):
    spike = ("2024-01-01 00:00:00", "hour")
    found = newcomers.spike_lifespans(events, *spike).collect()
    assert newcomers.spike_lifespans(events, *spike, newcomers.user_bounds(events)).collect() == found
    assert len(found) == 19


def test_summary_of_an_even_baseline_has_no_score(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:01:00", 2, "a", 0, 0)])
    r = newcomers.spike_summary(p, "2024-01-01 00:00:00").first()
    assert (r.spike_count, r.mean_count, r.std_count, r.z_score) == (1, 1.0, 0.0, None)
    r = newcomers.spike_summary(p, "2024-01-01 00:07:00").first()
    assert r.spike_count == 0 and not math.isnan(r.mean_count)


def test_reports_hold_together(events):
    window = ("2024-01-08", "2024-01-15")
    report = reports.baseline_report(events, *window)
    assert report["color_rank"].count() == 5
    contested = reports.contested_pixels_report(events, 10, 20, 25, 50, 240 * 60)
    assert contested["high_churn_pixels"].count() == 344
    assert contested["hot_pixel_users"].count() == 150
    assert contested["user_sessions_overall"].count() > contested["user_sessions"].count() > 0
    assert contested["focus_histogram"].agg(F.sum("n")).first()[0] == 50
    low = reports.low_diversity_report(events, 60, 5)
    assert low["low_diversity_users"].count() == 110
    assert low["top_user_maps"].select("user_id").distinct().count() == 5
    spike = reports.newcomer_spike_report(events, "2024-01-01 00:00:00", ("2024-01-03", "2024-01-05"), "hour", 42500, 42900)
    assert spike["spike_summary"].first().spike_count == 19
    assert spike["short_lived_map"].count() > 0
