"""Sample, features, split, model, scores and maps of the survival study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralog.operators import charts, evaluation, features, model, sampling
from muralog.sources.placements import write_table
from muralog.sources.scratch import stage


@dataclass(frozen=True)
class SurvivalSettings:
    """Parameters of the study; the defaults are those of the published one."""

    n_bins: int = 24
    n_total: int = 720_000
    survive_minutes: int = 30
    grid: int = 20
    lookback_minutes: int = 10
    folds: int = 5
    train_folds: int = 4
    num_trees: int = 150
    max_depth: int = 12
    seed: int = 42
    slice_minutes: int = 180
    map_bins: int = 120

    @property
    def label(self) -> str:
        return f"y_survives_{self.survive_minutes}m"

    @property
    def features(self) -> list[str]:
        return features.feature_names(self.lookback_minutes)


@dataclass(frozen=True)
class SurvivalData:
    train: DataFrame
    test: DataFrame
    features: DataFrame


def survival_data(df: DataFrame, s: SurvivalSettings = SurvivalSettings(), path: str | None = None) -> SurvivalData:
    """Sample the placements, compute label and features, split by time; each step is written once.

    With `path` the steps stay there as the tables `sampled`, `features`, `train` and `test`, for
    `read_survival_data`; otherwise they are scratch tables.
    """
    def keep(table: DataFrame, name: str) -> DataFrame:
        if path is None:
            return stage(table, name)
        write_table(table, f"{path}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}")

    sample = keep(sampling.stratified_time_sample(df, s.n_bins, s.n_total, s.seed), "sampled")
    table = keep(features.survival_features(df, sample, s.survive_minutes, s.grid, s.lookback_minutes), "features")
    train, test = sampling.temporal_split(table, s.folds, s.train_folds)
    if path is not None:
        train, test = keep(train, "train"), keep(test, "test")
    return SurvivalData(train, test, table)


def read_survival_data(spark: SparkSession, path: str) -> SurvivalData:
    """The tables that `survival_data` wrote to a path."""
    return SurvivalData(*[spark.read.parquet(f"{path}/{name}") for name in ("train", "test", "features")])


def class_balance(table: DataFrame, label: str) -> DataFrame:
    """`label, n, share` of each class."""
    counts = table.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = table.agg(F.count(F.lit(1))).scalar()
    return counts.select("label", "n", (F.col("n") / total).alias("share")).orderBy("label")


def fit(data: SurvivalData, s: SurvivalSettings = SurvivalSettings()) -> PipelineModel:
    return model.fit_survival_model(data.train, s.features, s.label, s.num_trees, s.max_depth, seed=s.seed)


def survival_report(data: SurvivalData, fitted: PipelineModel,
                    s: SurvivalSettings = SurvivalSettings()) -> dict[str, DataFrame]:
    """Scores, attributions and maps of a fitted model on the test part."""
    scored = stage(model.score_survival(fitted, data.test), "scored")
    attribution = stage(model.path_attribution(fitted, data.test), "attribution")
    return {
        "class_balance": class_balance(data.train, s.label),
        "classification_report": evaluation.classification_report(scored, s.label),
        "confusion_matrix": evaluation.confusion_matrix(scored, s.label),
        "feature_importance": evaluation.feature_importance(attribution),
        "attribution_direction": evaluation.attribution_direction(attribution),
        "midpoint_slice": sampling.midpoint_slice(scored, s.slice_minutes),
        "survival_map": charts.binned_mean_map(scored, bins=s.map_bins),
        "scored": scored,
    }
