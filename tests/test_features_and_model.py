from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from muralog.operators import evaluation, features, model
from muralog.plans import survival

SMALL = survival.SurvivalSettings(n_total=2400, survive_minutes=2880, grid=10, lookback_minutes=1440,
                                  num_trees=12, max_depth=6)


def brute_force(df, sample, size, minutes):
    """Neighbours by pairing, for small tables only."""
    s, f = features.grid_cell(sample, size).alias("s"), features.grid_cell(df, size).alias("f")
    near = (F.col("f.gx") == F.col("s.gx")) & (F.col("f.gy") == F.col("s.gy")) & (F.col("f.ts") < F.col("s.ts")) & (
        F.col("f.ts") >= F.col("s.ts") - F.make_dt_interval(mins=F.lit(minutes)))
    return s.join(f, near, "left").groupBy("s.event_id").agg(
        F.count("f.ts").alias("local_event_count"), F.countDistinct("f.user_id").alias("local_unique_users"),
        F.countDistinct("f.pc").alias("local_unique_colors"))


@pytest.mark.parametrize("minutes, slices", [(1, 8), (10, 8), (10, 1), (240, 3), (2000, 8)])
def test_neighbourhood_equals_pairing(skewed, minutes, slices):
    holes = skewed.withColumn("pc", F.when(F.col("event_id") % 5 > 0, F.col("pc"))).withColumn(
        "user_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    sample = holes.filter("event_id % 4 = 1 OR event_id < 200")
    ours = features.neighborhood_activity(holes, sample, 10, minutes, slices).orderBy("event_id").collect()
    assert ours == brute_force(holes, sample, 10, minutes).orderBy("event_id").collect()
    assert len(ours) == sample.count()


def test_neighbourhood_does_not_depend_on_how_the_sample_is_joined(skewed, monkeypatch):
    import muralog.sources.scratch as scratch

    sample = skewed.filter("event_id % 4 = 1")
    shipped = features.neighborhood_activity(skewed, sample, 10, 10).orderBy("event_id").collect()
    monkeypatch.setattr(scratch.broadcast_if_small, "__defaults__", (0,))
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert features.neighborhood_activity(skewed, sample, 10, 10).orderBy("event_id").collect() == shipped
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookback_edges(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:10:00", 2, "b", 1, 1),
               (3, "2024-01-01 00:10:00", 3, "b", 2, 2), (4, "2024-01-01 00:20:00.000001", 4, "c", 3, 3)])
    got = {r.event_id: (r.local_event_count, r.local_unique_users, r.local_unique_colors)
           for r in features.neighborhood_activity(p, p).collect()}
    assert got == {1: (0, 0, 0), 2: (1, 1, 1), 3: (1, 1, 1), 4: (0, 0, 0)}


def test_steps_are_shuffled_once(skewed):
    local = features.neighborhood_activity(skewed, skewed)
    local.collect()
    plan = local._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert any("ReusedExchange [gx" in line and "sum#" in line for line in plan.splitlines())


def test_no_pairs_are_formed(skewed):
    plan = features.neighborhood_activity(skewed, skewed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join Cross" not in plan


def test_label_rules(place):
    p = place([(1, "2024-01-01 00:00:00", 1, "a", 0, 0), (2, "2024-01-01 00:30:00", 1, "a", 0, 0),
               (3, "2024-01-01 00:59:59.999999", 1, "a", 0, 0), (4, "2024-01-01 00:00:00", 1, "a", 1, 0)])
    got = {r.event_id: r.y_survives_30m for r in features.survival_label(p).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}
    history = {r.event_id: (r.prior_changes_at_pixel, r.time_since_last_change_sec) for r in features.pixel_history(p).collect()}
    assert history[1] == (0, 1e9) and history[2] == (1, 1800.0) and history[4] == (0, 1e9)


def test_twin_rows_do_not_multiply(place):
    twins = [(i, "2024-01-01 00:00:00", i, "a", 0, 0) for i in (1, 2)] + [(3, "2024-01-01 01:00:00", 3, "a", 0, 0)]
    p = place(twins)
    got = features.survival_features(p, p.filter("event_id < 3"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("ship", [0, 10**6])
def test_timeline_does_not_depend_on_how_the_sample_is_joined(skewed, ship, monkeypatch):
    import muralog.sources.scratch as scratch

    monkeypatch.setattr(scratch.broadcast_if_small, "__defaults__", (ship,))
    sample = skewed.filter("event_id % 3 = 0")
    whole = features.pixel_timeline(skewed).filter("event_id % 3 = 0")
    ours = features.pixel_timeline(skewed, sample, target_rows=100)
    assert ours.select(*whole.columns).exceptAll(whole).isEmpty() and ours.count() == whole.count()


def test_grid_of_negative_coordinates(place):
    r = features.grid_cell(place([(1, "2024-01-01 00:00:00", 1, "a", -1, 40)])).first()
    assert (r.gx, r.gy) == (-1, 2)


@pytest.fixture(scope="module")
def study(spark, events):
    data = survival.survival_data(events, SMALL)
    return data, survival.fit(data, SMALL)


def test_published_sums_hold(events):
    sample = events.filter("event_id % 4 = 0")
    table = features.survival_features(events, sample, 2880, 10, 1440)
    names = features.feature_names(1440)
    changed = F.when(F.col("prior_changes_at_pixel") > 0, F.col("time_since_last_change_sec"))
    sums = table.agg(F.count("*"), F.sum("y_survives_2880m"), F.sum(names[1]), F.sum(changed), *[F.sum(n) for n in names[3:]]).first()
    assert tuple(sums)[:3] == (2500, 1322, 13767) and sums[3] == pytest.approx(541388047.468)
    assert tuple(sums)[4:] == (84349, 73186, 11914)


def test_split_keeps_all_rows_in_order(study):
    data, _ = study
    assert (data.features.count(), data.train.count(), data.test.count()) == (2400, 1920, 480)
    assert data.train.agg(F.max("ts")).first()[0] <= data.test.agg(F.min("ts")).first()[0]
    assert data.train.columns == data.features.columns


def test_classes_weigh_the_same(study):
    data, _ = study
    weights = model.with_class_weight(data.train, SMALL.label).groupBy(SMALL.label).agg(F.sum("class_weight").alias("w")).collect()
    assert [r.w for r in weights] == pytest.approx([960.0, 960.0])


def test_contributions_add_up_to_the_probability(study, monkeypatch):
    data, fitted = study
    scored = model.score_survival(fitted, data.test).select("event_id", "survival_prob")
    shares = model.path_attribution(fitted, data.test)
    total = shares.groupBy("event_id").agg((F.sum("contribution") + F.first("base_value")).alias("p"))
    gap = scored.join(total, "event_id").agg(F.count("*"), F.max(F.abs(F.col("p") - F.col("survival_prob")))).first()
    assert gap[0] == 480 and gap[1] < 1e-9
    biggest = model.forest_nodes(fitted, data.test.sparkSession).groupBy("tree").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(model, "NODES_PER_GROUP", biggest)
    assert max(model.tree_groups(model.forest_nodes(fitted, data.test.sparkSession))[0].values()) > 1
    parts = model.path_attribution(fitted, data.test)
    both = shares.join(parts.withColumnRenamed("contribution", "c"), ["event_id", "feature"])
    assert both.count() == 480 * 6
    assert both.agg(F.max(F.abs(F.col("c") - F.col("contribution")))).first()[0] < 1e-9


def test_a_study_without_survivors(spark):
    """Where no pixel of the train part survives, the forest knows class 0 alone."""
    rows = [(i, float(i % 7), float(i % 3), 0) for i in range(60)]
    table = spark.createDataFrame(rows, "event_id long, a double, b double, y int")
    fitted = model.fit_survival_model(table, ["a", "b"], "y", num_trees=3, max_depth=3)
    scored = model.score_survival(fitted, table).collect()
    assert len(scored) == 60 and {(r.survival_prob, r.prediction) for r in scored} == {(0.0, 0)}
    shares = model.path_attribution(fitted, table).collect()
    assert len({(r.event_id, r.feature) for r in shares}) == len(shares) == 120
    assert {(r.contribution, r.base_value) for r in shares} == {(0.0, 0.0)}


def test_a_tree_above_the_bound_is_refused(study, monkeypatch):
    data, fitted = study
    monkeypatch.setattr(model, "NODES_PER_GROUP", 2)
    with pytest.raises(ValueError):
        model.path_attribution(fitted, data.test)


def test_report_of_the_study(study):
    data, fitted = study
    report = survival.survival_report(data, fitted, SMALL)
    matrix = {r.label: (r.predicted_0, r.predicted_1) for r in report["confusion_matrix"].collect()}
    right, total = matrix[0][0] + matrix[1][1], sum(map(sum, matrix.values()))
    scores = {r["class"]: r for r in report["classification_report"].collect()}
    assert total == 480 and scores["accuracy"].f1_score == pytest.approx(right / total)
    assert report["feature_importance"].count() == 6
    assert report["survival_map"].count() > 0
    assert report["midpoint_slice"].count() > 0
    assert model.model_importance(fitted, data.train.sparkSession).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_scores_without_hits(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, prediction int")
    got = {r["class"]: r for r in evaluation.classification_report(pred, "y").collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1_score, got["1"].support) == (0.0, 0.0, 0.0, 1)
    assert got["0"].precision == pytest.approx(2 / 3) and got["accuracy"].f1_score == pytest.approx(2 / 3)
    assert got["accuracy"].precision is None and got["weighted avg"].support == 3
    matrix = [tuple(r) for r in evaluation.confusion_matrix(pred.filter("y = 0"), "y").collect()]
    assert matrix == [(0, 2, 0), (1, 0, 0)]


def test_direction(spark):
    rows = [("up", float(i), i * 0.5) for i in range(5)] + [("down", float(i), -i * 0.5) for i in range(5)] + [
        ("flat", 1.0, 0.2), ("flat", 1.0, 0.3)]
    df = spark.createDataFrame(rows, "feature string, value double, contribution double")
    got = {r.feature: r.direction for r in evaluation.attribution_direction(df).collect()}
    assert got == {"up": 1, "down": -1, "flat": 0}
    assert evaluation.feature_importance(df).first().feature in ("up", "down")
