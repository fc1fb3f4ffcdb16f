"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixture as fx
from muralog.functions.clock import within
from muralog.operators import (activity, baseline, charts, churn, diversity, evaluation, features, folds, heavy, intervals, model,
                               newcomers, rollups, sampling, sessions, spikes, tiles)
from muralog.plans import reports, survival
from muralog.sources import upkeep
from muralog.sources.placements import read_placements, write_placements
from muralog.sources.raw_log import ingest_placements, read_raw_log
from muralog.sources.scratch import scratch_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LABEL = f"y_survives_{fx.SURVIVE_MINUTES}m"


def query(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function of the placement table under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fx.comparable(fn(fx.placements(spark, sf_dir)))
    return fn


# Ingestion

def ingest_placements_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ingest_placements(fx.raw_log(spark, sf_dir))
    return fx.comparable(placed.select("ts", "pc", "x", "y"))


def ingest_csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, table = scratch_path(spark, "raw-csv"), scratch_path(spark, "placements")
    fx.raw_log(spark, sf_dir).write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(raw)
    write_placements(ingest_placements(read_raw_log(spark, raw)), table)
    per_user = read_placements(spark, table).groupBy(F.col("event_date").cast("string").alias("day"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    return fx.comparable(per_user.drop("user_id"))


QUERIES["ingest_placements"] = ingest_placements_query
QUERIES["ingest_csv_to_parquet"] = ingest_csv_to_parquet


# Baseline

@query
def color_rank(df):
    return baseline.color_rank(df, *fx.WINDOW)


@query
def avg_session_length(df):
    return sessions.avg_session_length(df, *fx.WINDOW, gap_seconds=fx.SESSION_GAP)


@query
def placement_percentiles(df):
    return baseline.placement_percentiles(df, *fx.WINDOW)


@query
def first_time_users(df):
    return baseline.first_time_users(df, *fx.FIRST_WINDOW)


# Contested pixels

@query
def pixel_churn(df):
    return churn.pixel_churn(df)


@query
def high_churn_pixels(df):
    return churn.high_churn_pixels(df, fx.CHURN)


@query
def hot_pixels(df):
    return churn.hot_pixels(df, fx.HOT)


@query
def hottest_pixels(df):
    return churn.hot_pixels(df, fx.HOTTEST)


@query
def hot_pixel_users(df):
    return churn.hot_pixel_users(df, churn.hot_pixels(df, fx.HOT))


@query
def top_users(df):
    return churn.top_users(hot_pixel_users(df), fx.TOP_USERS)


@query
def inter_placement_deltas(df):
    return sessions.inter_placement_deltas(df, top_users(df)).dropna()


@query
def user_sessions(df):
    return sessions.user_sessions(df, top_users(df), fx.SESSION_GAP)


@query
def user_sessions_overall(df):
    return sessions.user_sessions(df, None, fx.SESSION_GAP)


@query
def hot_edit_focus(df):
    return churn.hot_edit_focus(df, top_users(df), churn.hot_pixels(df, fx.HOTTEST))


# Colour diversity

@query
def low_diversity_users(df):
    return diversity.low_diversity_users(df, **fx.LOW_DIVERSITY)


@query
def cohort_placements(df):
    return diversity.cohort_placements(df, low_diversity_users(df))


@query
def top_cohort_placements(df):
    return diversity.top_cohort_placements(df, low_diversity_users(df), 5)


@query
def dominant_color_share(df):
    return diversity.dominant_color_share(df)


@query
def color_diversity_distribution(df):
    return diversity.color_diversity_distribution(df, 50)


# Activity

@query
def activity_per_minute(df):
    return activity.activity_per_minute(df)


@query
def top_minutes(df):
    return activity.top_minutes(df, 10)


@query
def activity_in_range(df):
    return activity.activity_in_range(df, *fx.RANGE)


@query
def minute_heatmap(df):
    return activity.minute_heatmap(df, fx.SPIKE, fx.UNIT)


@query
def active_users_per_minute(df):
    return activity.active_users_per_minute(df)


# Newcomers

@query
def spike_first_time_users(df):
    return newcomers.spike_first_time_users(df, fx.SPIKE, fx.UNIT)


@query
def first_time_user_baseline(df):
    return newcomers.first_time_user_baseline(df, fx.UNIT)


@query
def spike_summary(df):
    return newcomers.spike_summary(df, fx.SPIKE, fx.UNIT)


@query
def spike_lifespans(df):
    return newcomers.spike_lifespans(df, fx.SPIKE, fx.UNIT)


@query
def spike_lifespan_summary(df):
    return newcomers.spike_lifespan_summary(df, fx.SPIKE, fx.UNIT)


@query
def short_lived_placements(df):
    return newcomers.lifespan_cohort_placements(df, spike_lifespans(df), max_minutes=fx.SHORT)


@query
def long_lived_placements(df):
    return newcomers.lifespan_cohort_placements(df, spike_lifespans(df), min_minutes=fx.LONG)


@query
def new_user_spikes(df):
    return newcomers.new_user_spikes(df, 1.0, fx.UNIT)


# Sampling

@query
def time_bin(df):
    return sampling.with_time_bin(df, fx.N_BINS).select("event_id", "time_bin")


@query
def stratified_time_sample(df):
    return sampling.stratified_time_sample(df, fx.N_BINS, fx.N_TOTAL, fx.SEED)


@query
def uniform_sample(df):
    return sampling.uniform_sample(df, 1500, fx.SEED)


@query
def midpoint_slice(df):
    return sampling.midpoint_slice(df)


@query
def temporal_split(df):
    train, test = sampling.temporal_split(df)
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part")))


# Survival features, for every placement

@query
def survival_label(df):
    return features.survival_label(df, minutes=fx.SURVIVE_MINUTES).select("event_id", "ts", "next_ts", LABEL)


@query
def pixel_history(df):
    return features.pixel_history(df).select("event_id", "prior_changes_at_pixel", "time_since_last_change_sec")


@query
def grid_cell(df):
    return features.grid_cell(df, fx.GRID).select("event_id", "gx", "gy")


@query
def neighborhood_activity(df):
    return features.neighborhood_activity(df, df, fx.GRID, fx.LOOKBACK_MINUTES)


@query
def survival_features(df):
    return features.survival_features(df, df, fx.SURVIVE_MINUTES, fx.GRID, fx.LOOKBACK_MINUTES)


@query
def sampled_survival_features(df):
    sample = stage(stratified_time_sample(df), "time-sample")
    return features.survival_features(df, sample, fx.SURVIVE_MINUTES, fx.GRID, fx.LOOKBACK_MINUTES)


# Evaluation, over a prediction and an attribution that a plain rule gives

def rule_prediction(df):
    """Label and history of every placement, and the guess that quiet pixels survive."""
    known = features.pixel_timeline(df).withColumn(LABEL, features.survives(fx.SURVIVE_MINUTES))
    return known.withColumn("prediction", (F.col("prior_changes_at_pixel") <= 3).cast("int"))


def rule_attribution(df):
    """Long table `feature, value, contribution` from the history of every placement."""
    known = rule_prediction(df)
    tilt = F.col(LABEL) - F.lit(0.5)
    prior = F.col("prior_changes_at_pixel").cast("double")
    gap = F.log1p(F.col("time_since_last_change_sec"))
    return known.select(F.inline(F.array(
        F.struct(F.lit("prior_changes_at_pixel").alias("feature"), prior.alias("value"), (tilt * prior).alias("contribution")),
        F.struct(F.lit("log_time_since_last_change").alias("feature"), gap.alias("value"), (tilt / (gap + 1)).alias("contribution")),
    )))


@query
def classification_report(df):
    return evaluation.classification_report(rule_prediction(df), LABEL)


@query
def confusion_matrix(df):
    return evaluation.confusion_matrix(rule_prediction(df), LABEL)


@query
def feature_importance(df):
    return evaluation.feature_importance(rule_attribution(df))


@query
def attribution_direction(df):
    return evaluation.attribution_direction(rule_attribution(df))


# Chart tables

@query
def binned_mean_map(df):
    known = rule_prediction(df).withColumn("survival_prob", F.col(LABEL).cast("double"))
    return charts.binned_mean_map(known, "survival_prob", 12)


@query
def delta_histogram(df):
    return charts.histogram(inter_placement_deltas(df), "delta_seconds", 100, log10=True)


@query
def session_histogram(df):
    return charts.histogram(user_sessions(df), "session_length_min", 50, log10=True)


@query
def session_histogram_overall(df):
    return charts.histogram(user_sessions_overall(df), "session_length_min", 50, log10=True)


@query
def focus_histogram(df):
    return charts.histogram(hot_edit_focus(df), "hot_edit_ratio", 30)


@query
def lifespan_histogram(df):
    return charts.histogram(spike_lifespans(df), "lifespan_minutes", 50)


@query
def cohort_map(df):
    return charts.bin2d(cohort_placements(df), 120)


@query
def top_cohort_maps(df):
    return charts.bin2d(top_cohort_placements(df), 80, facet="user_id")


@query
def short_lived_map(df):
    return charts.bin2d(short_lived_placements(df), 100)


@query
def long_lived_map(df):
    return charts.bin2d(long_lived_placements(df), 100)


# Model: results depend on the fitted forest, so there is no SQL for them

SETTINGS = survival.SurvivalSettings(
    n_bins=fx.N_BINS, n_total=fx.N_TOTAL, survive_minutes=fx.SURVIVE_MINUTES, grid=fx.GRID,
    lookback_minutes=fx.LOOKBACK_MINUTES,
)


_FITTED: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf_dir):
    """Data and forest, trained once per application and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        data = survival.survival_data(fx.placements(spark, sf_dir), SETTINGS)
        _FITTED[key] = data, survival.fit(data, SETTINGS)
    return _FITTED[key]


def fit_survival_model(spark, sf_dir):
    """Rows and weight of each class, and what the fitted forest says of itself."""
    data, fitted = _fitted(spark, sf_dir)
    importance = model.model_importance(fitted, spark).agg(F.round(F.sum("importance"), 6).alias("total")).first()[0]
    weighted = model.with_class_weight(data.train, LABEL)
    return fx.comparable(weighted.groupBy(F.col(LABEL).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("class_weight").alias("weight")).withColumns({
            "trees": F.lit(len(fitted.stages[-1].trees)).cast("long"), "total_importance": F.lit(float(importance))}))


def score_survival(spark, sf_dir):
    """The test part with what must hold for any forest."""
    data, fitted = _fitted(spark, sf_dir)
    prob = F.col("survival_prob")
    return fx.comparable(model.score_survival(fitted, data.test).select(
        "event_id", LABEL, prob.between(0.0, 1.0).alias("is_probability"),
        ((prob > 0.5) == (F.col("prediction") == 1)).alias("prediction_follows")))


def path_attribution(spark, sf_dir):
    """Every feature of every row of the test part; contributions and base add up to the probability."""
    data, fitted = _fitted(spark, sf_dir)
    shares = stage(model.path_attribution(fitted, data.test), "attribution")
    sums = shares.groupBy("event_id").agg((F.sum("contribution") + F.first("base_value")).alias("total"))
    scored = model.score_survival(fitted, data.test).select("event_id", "survival_prob")
    agrees = sums.join(scored, "event_id").select("event_id", (F.abs(F.col("total") - F.col("survival_prob")) < 1e-6).alias("adds_up"))
    return fx.comparable(shares.select("event_id", "feature", "value").join(agrees, "event_id"))


def survival_round_trip(spark, sf_dir):
    """The study's tables, written to a path, read back and counted by label."""
    path = scratch_path(spark, "survival-study")
    survival.survival_data(fx.placements(spark, sf_dir), SETTINGS, path)
    data = survival.read_survival_data(spark, path)
    tables = [("train", data.train), ("test", data.test), ("features", data.features)]
    parts = [t.select(F.lit(n).alias("part"), LABEL, "event_id") for n, t in tables]
    return fx.comparable(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", F.col(LABEL).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")))


def class_balance(spark, sf_dir):
    data, _ = _fitted(spark, sf_dir)
    return fx.comparable(survival.class_balance(data.train, LABEL))


def appended_pixel_history(spark, sf_dir):
    """History of every placement after the raw log was ingested in two halves, the second one appended."""
    raw = fx.raw_log(spark, sf_dir).withColumn("odd", F.unix_micros("timestamp") % 2 == 1)
    table = scratch_path(spark, "appended")
    for odd, mode in ((False, "error"), (True, "append")):
        write_placements(ingest_placements(raw.filter(F.col("odd") == odd).drop("odd")), table, mode)
    history = features.pixel_history(read_placements(spark, table)).select("event_id", "prior_changes_at_pixel", "time_since_last_change_sec")
    placed = read_placements(spark, table).select("event_id", "ts", "x", "y")
    return fx.comparable(placed.join(history, "event_id").drop("event_id"))


for _named in (fit_survival_model, score_survival, path_attribution, survival_round_trip, class_balance, appended_pixel_history):
    QUERIES[_named.__name__] = _named


# What the reports show besides

@query
def newcomers_per_minute(df):
    return newcomers.newcomers_per_minute(df, fx.UNIT)


@query
def user_cadence(df):
    return sessions.user_cadence(sessions.inter_placement_deltas(df, top_users(df)), 3600)


@query
def user_spread(df):
    return diversity.user_spread(df, low_diversity_users(df))


@query
def cut_pixel_history(df):
    """`pixel_history` with all but the quietest pixels cut, into about a hundred pieces however long the table is."""
    return features.pixel_history(df, target_rows=5, piece_rows=max(5, df.count() // 50)).select("event_id", "prior_changes_at_pixel", "time_since_last_change_sec")


@query
def newcomers_per_quarter(df):
    return newcomers.spike_first_time_users(df, "2024-01-01 00:00:00", "quarter")


# Places in time, neighbours themselves, stored sessions

@query
def time_rank(df):
    return folds.time_rank(df, max(100, df.count() // 20)).select("event_id", "time_rank")


@query
def time_fold(df):
    return folds.time_fold(df, 5, max(100, df.count() // 20)).select("event_id", "fold")


@query
def uneven_time_fold(df):
    """Folds that the rows do not divide into."""
    return folds.fold_summary(folds.time_fold(df, 7, max(100, df.count() // 20)))


@query
def forward_chaining(df):
    """Rows and time span of each round of the cross-validation by time."""
    folded = stage(folds.time_fold(df, 5), "folded")
    rounds = [part.select(F.lit(k + 2).alias("round"), F.lit(name).alias("part"), "ts") for k, pair in enumerate(folds.forward_chaining(folded, 5))
              for name, part in zip(("train", "test"), pair)]
    every = reduce(DataFrame.unionByName, rounds)
    return every.groupBy("round", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _asked(df):
    return stage(sampling.uniform_sample(df, fx.N_ASKED, fx.SEED), "asked")


@query
def neighbors_before(df):
    return intervals.neighbors_before(df, _asked(df), fx.GRID, fx.LOOKBACK_MINUTES, target_rows=max(20, df.count() // 2000))


@query
def neighborhood_profile(df):
    return intervals.neighborhood_profile(df, _asked(df), fx.GRID, fx.LOOKBACK_MINUTES).fillna(-1, ["last_near_event_id"])


def _stored(spark, sf_dir):
    """A store that has taken the placements in three batches: even days, odd days, and late rows of all days."""
    df = fx.placements(spark, sf_dir)
    late, odd = F.col("event_id") % 10 == 3, F.dayofyear("ts") % 2 == 1
    path = scratch_path(spark, "session-store")
    for part in (~late & ~odd, ~late & odd, late):
        upkeep.append_batch(df.filter(part), path, fx.SESSION_GAP)
    return path


def appended_sessions(spark, sf_dir):
    return fx.comparable(upkeep.stored_sessions(spark, _stored(spark, sf_dir)).drop("events"))


def appended_user_bounds(spark, sf_dir):
    return fx.comparable(upkeep.stored_users(spark, _stored(spark, sf_dir)))


for _named in (appended_sessions, appended_user_bounds):
    QUERIES[_named.__name__] = _named


# Stored rollups, heavy hitters, tiles, running baselines

def _rollup(df):
    """Written and read again, as a report would find it."""
    return stage(rollups.activity_rollup(df, "hour"), "activity-rollup")


@query
def rollup_users(df):
    """Exact users of a window by colour, and whether the sketches' estimate is within four of its deviations."""
    exact = df.filter(within(F.col("ts"), *fx.HOURS)).groupBy("pc").agg(F.count_distinct("user_id").alias("users"))
    asked = rollups.distinct_users(_rollup(df), *fx.HOURS, by=["pc"]).withColumnRenamed("users", "estimate")
    error = F.abs(F.col("estimate") - F.col("users")) <= F.lit(4 * rollups.DISTINCT_ERROR) * F.col("users") + 1
    return asked.join(exact, "pc").select("pc", "placements", "users", error.alias("within_error"))


@query
def rollup_percentiles(df):
    """Exact quartiles of the values of a window, and whether the sketches' ranks are within the stated error of the shares."""
    inside = df.filter(within(F.col("ts"), *fx.HOURS)).select(F.col("ts"), (F.col("x") * 40 + F.col("y")).alias("place"))
    shares = [0.25, 0.5, 0.75, 0.99]
    stored = stage(rollups.value_rollup(df.withColumn("place", F.col("x") * 40 + F.col("y")), "place", unit="hour"), "value-rollup")
    asked = rollups.percentiles(stored, shares, *fx.HOURS)
    exact = inside.agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY place)").alias(f"e{i}") for i, s in enumerate(shares)])
    ranks = stage(asked, "asked").join(F.broadcast(inside.groupBy("place").agg(F.count(F.lit(1)).alias("k"))), F.col("place") <= F.col("value")).groupBy("percentile", "n", "value").agg(
        F.sum("k").alias("upto"), F.max(F.struct("place", "k"))["k"].alias("ties"))
    good = (F.col("upto") / F.col("n") >= F.col("percentile") - rollups.RANK_ERROR) & ((F.col("upto") - F.col("ties")) / F.col("n") <= F.col("percentile") + rollups.RANK_ERROR)
    named = exact.select(F.inline(F.array(*[F.struct(F.lit(s).alias("percentile"), F.col(f"e{i}").cast("int").alias("exact")) for i, s in enumerate(shares)])))
    return ranks.join(named, "percentile").select("percentile", "n", "exact", good.alias("within_error"))


@query
def heavy_pixels(df):
    """`hot_pixels` without a count of every pixel."""
    return heavy.heavy_hitters(df, ["x", "y"], fx.HOT).withColumnRenamed("n", "edits")


@query
def heavy_users(df):
    return heavy.heavy_hitters(df, ["user_id"], max(1, df.count() // 500)).withColumnRenamed("n", "edits")


@query
def tile_pyramid(df):
    return tiles.tile_pyramid(df.withColumn("hour", F.hour("ts")), levels=7, value="hour")


@query
def running_baseline(df):
    counts = df.filter(F.col("ts").isNotNull()).groupBy(F.date_trunc("hour", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return spikes.running_baseline(counts, "n", unit_seconds=3600, periods=14)


@query
def running_spikes(df):
    return spikes.running_spikes(df, 2.0, "hour", 3600, least=2)


# One table of each report, from the report itself

@query
def report_color_rank(df):
    return reports.baseline_report(df, *fx.WINDOW, fx.SESSION_GAP)["color_rank"]


@query
def report_hot_edit_focus(df):
    return reports.contested_pixels_report(df, fx.CHURN, fx.HOT, fx.HOTTEST, fx.TOP_USERS, fx.SESSION_GAP)["hot_edit_focus"]


@query
def report_user_spread(df):
    return reports.low_diversity_report(df, fx.LOW_DIVERSITY["min_edits"], fx.LOW_DIVERSITY["max_colors"])["user_spread"]


@query
def report_spike_summary(df):
    return reports.newcomer_spike_report(df, fx.SPIKE, unit=fx.UNIT)["spike_summary"]
