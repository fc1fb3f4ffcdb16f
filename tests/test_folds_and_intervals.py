"""Ranks and folds in time, and joins of intervals with events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from muralog.operators import folds, intervals


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("piece_rows", [2_000_000, 100, 7])
def test_ranks_are_those_of_the_order(skewed, piece_rows):
    """With ties in time; every piece is bounded, however much falls on one instant."""
    ranked = folds.time_rank(skewed, piece_rows)
    found = sorted((r.time_rank, r.ts, r.event_id) for r in ranked.collect())
    assert [r[0] for r in found] == list(range(3000)) and [r[1:] for r in found] == sorted(r[1:] for r in found)
    # The only window without a partition is the one over the ranges' lengths, which is staged before.
    assert "SinglePartition" not in plan_of(ranked) and "Window" in plan_of(ranked)


def test_ranges_of_repeated_rows_are_bounded(spark, tmp_path, monkeypatch):
    """A third of the rows are one row over and over, another part has no time or id."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).cast("long").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(1000))).when(F.col("id") % 40 == 1, None).otherwise(F.timestamp_seconds(F.col("id"))).alias("ts"))
    written = []
    real = folds.stage
    monkeypatch.setattr(folds, "stage", lambda df, label: written.append(real(df, label)) or written[-1])
    ranked = folds.time_rank(rows, 200).collect()
    assert sorted(r.time_rank for r in ranked) == list(range(3000))
    assert max(r["count"] for r in written[0].groupBy("_piece").count().collect()) <= 400
    by_rank = [(r.ts is None, r.ts, r.event_id is None, r.event_id) for r in sorted(ranked, key=lambda r: r.time_rank)]
    assert [x[0] for x in by_rank] == sorted(x[0] for x in by_rank)
    assert all(a[1] < b[1] or a[1] == b[1] and (a[2], a[3] or 0) <= (b[2], b[3] or 0) for a, b in zip(by_rank, by_rank[1:]) if not b[0])


@pytest.mark.parametrize("rows, n", [(0, 5), (3, 5), (5, 5), (17, 5), (20, 7), (1, 1)])
def test_folds_are_even(place, rows, n):
    df = place([(i, f"2024-01-01 00:00:{i:02d}", 1, "#000000", 0, 0) for i in range(rows)] or [(0, None, 1, "", 0, 0)]).filter(F.lit(rows > 0))
    got = [r.fold for r in folds.time_fold(df, n).orderBy("ts").collect()]
    each, longer = divmod(rows, n)
    assert got == [k + 1 for k in range(n) for _ in range(each + (k < longer))]


def test_rounds_never_see_what_comes_later(skewed):
    folded = folds.time_fold(skewed, 4)
    rounds = folds.forward_chaining(folded, 4)
    assert len(rounds) == 3
    for train, test in rounds:
        last, first = train.agg(F.max(F.struct("ts", "event_id"))).first()[0], test.agg(F.min(F.struct("ts", "event_id"))).first()[0]
        assert last < first
    assert sum(test.count() for _, test in rounds) == folded.filter("fold > 1").count()


def plain_pairs(asked, events, seconds):
    return sorted((a.event_id, e.event_id) for a in asked for e in events
                  if None not in (a.x, e.x, a.ts, e.ts) and a.x == e.x and 0 < (a.ts - e.ts).total_seconds() <= seconds)


@pytest.mark.parametrize("seconds, width, target", [(600, 600, 100_000), (600, 600, 10), (3600, 250, 5), (60, 86_400, 20), (90_000, 3600, 1000)])
def test_interval_join_finds_all_pairs(skewed, seconds, width, target):
    """Whatever the buckets and however finely hot ones are dealt out."""
    asked = skewed.filter("event_id % 11 = 0")
    back = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    joined = intervals.interval_join(asked, skewed, ["x"], F.col("ts") - back, F.col("ts"), width, target)
    assert joined.columns == [*asked.columns, *[f"near_{c}" for c in skewed.columns]]
    found = sorted((r.event_id, r.near_event_id) for r in joined.select("event_id", "near_event_id").collect())
    assert found == plain_pairs(asked.collect(), skewed.collect(), seconds) and found


def test_a_burst_is_dealt_out(skewed, monkeypatch):
    """A third of the events in one cell: its bucket is joined in pieces of about the target."""
    split = []
    real = intervals.stage
    monkeypatch.setattr(intervals, "stage", lambda df, label: split.append(real(df, label)) or split[-1])
    asked = skewed.filter("event_id % 5 = 0")
    intervals.interval_join(asked, skewed, ["x"], F.col("ts") - F.expr("INTERVAL 2 DAY"), F.col("ts"), 5 * 86_400, 50).count()
    pieces = [r for df in split if "event_pieces" in df.columns for r in df.collect()]
    hot = max(pieces, key=lambda r: r.event_pieces)
    assert hot._x == 5 and hot.event_pieces >= 1000 // 50 and hot.asked_pieces >= 200 // 50
    sizes = skewed.filter("x = 5").groupBy(F.pmod(F.xxhash64("event_id"), F.lit(hot.event_pieces))).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 50


def test_interval_join_odd_rows(place):
    events = place([(1, "2024-01-01 00:00:00", 1, "a", 1, 1), (2, None, 1, "a", 1, 1), (3, "2024-01-01 00:00:05", 1, "a", None, 1), (4, "2024-01-01 00:00:00", 1, "b", 1, 1), (4, "2024-01-01 00:00:00", 1, "b", 1, 1)])
    asked = place([(10, "2024-01-01 00:00:00", 1, "a", 1, 1), (11, "2024-01-01 00:00:10", 1, "a", 1, 1), (12, None, 1, "a", 1, 1), (13, "2024-01-01 00:00:10", 1, "a", None, 1), (14, "2024-01-01 00:00:10.000001", 1, "a", 1, 1)])
    args = (["x"], F.col("ts") - F.expr("INTERVAL 10 SECOND"), F.col("ts"), 10)
    found = sorted((r.event_id, r.near_event_id) for r in intervals.interval_join(asked, events, *args).collect())
    assert found == [(11, 1), (11, 4), (11, 4)]
    left = intervals.interval_join(asked, events, *args, how="left")
    assert sorted((r.event_id, r.near_event_id or 0) for r in left.collect()) == [(10, 0), (11, 1), (11, 4), (11, 4), (12, 0), (13, 0), (14, 0)]
    counts = intervals.interval_aggregate(asked, events, *args, [F.count("near_event_id").alias("n"), F.count_distinct("near_pc").alias("pcs")])
    assert {r.event_id: (r.n, r.pcs) for r in counts.collect()} == {10: (0, 0), 11: (3, 2), 12: (0, 0), 13: (0, 0), 14: (0, 0)}
    assert intervals.interval_join(asked.limit(0), events, *args).count() == 0 and intervals.interval_join(asked, events.limit(0), *args).count() == 0
    # An interval that ends before it begins holds nothing.
    assert intervals.interval_join(asked, events, ["x"], F.col("ts"), F.col("ts") - F.expr("INTERVAL 10 SECOND"), 10).count() == 0
