"""Scores of a prediction and summaries of an attribution, from tables that already exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.sources.scratch import stage


def classification_report(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """`class, precision, recall, f1_score, support`: one row per class, then accuracy and both means.

    Rows are counted by (label, prediction) once; everything else is arithmetic on
    that small table. A ratio with nothing in its denominator is 0. The accuracy
    row has its value under `f1_score`, with no precision or recall.
    """
    pairs = _pairs(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0)
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hit")),
        F.struct(F.col("guess").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
    )))
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hit")])
    precision, recall = _ratio("hit", "guessed"), _ratio("hit", "support")
    by_class = totals.select(
        F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1_score"),
        "support", "hit",
    )
    scores = ("precision", "recall", "f1_score")
    overall = by_class.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(c).alias(f"macro_{c}") for c in scores],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")).alias(f"weighted_{c}") for c in scores],
    )
    none = F.lit(None).cast("double")
    means = overall.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"), _ratio("hit", "support").alias("f1_score"), "support"),
        *[F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{c}").alias(c) for c in scores], "support") for kind in ("macro", "weighted")],
    )))
    return by_class.drop("hit").unionByName(means)


def confusion_matrix(pred: DataFrame, label: str, prediction: str = "prediction",
                     classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """`label, predicted_<class>...`: counts, with a row and a column for every class that occurs.

    `classes` are listed even if they never occur. Rows without a label or guess are a class of
    their own, `NULL` and `predicted_null`, where there are any; so the cells always add up to
    the rows.
    """
    found = stage(_pairs(pred, label, prediction), "class-pairs")  # one row per pair of classes
    seen = {r[0] for r in found.select(F.explode(F.array("label", "guess"))).distinct().collect()}
    listed = [*sorted({*classes, *seen} - {None}), *([None] if None in seen else [])]
    rows = found.sparkSession.createDataFrame([(c,) for c in listed], "class int")
    name = lambda c: "null" if c is None else c
    return (
        F.broadcast(rows).join(found, F.col("class").eqNullSafe(F.col("label")), "left").groupBy(F.col("class").alias("label"))
        .agg(*[F.coalesce(F.sum(F.when(F.col("guess").eqNullSafe(F.lit(c)), F.col("n"))), F.lit(0)).alias(f"predicted_{name(c)}") for c in listed])
        .orderBy("label")
    )


def feature_importance(attribution: DataFrame) -> DataFrame:
    """`feature, importance`: mean absolute contribution, strongest first."""
    return (
        attribution.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def attribution_direction(attribution: DataFrame) -> DataFrame:
    """`feature, correlation, direction` between a feature's value and its contribution.

    Direction is 1 where higher values raise the outcome, -1 where they lower it
    and 0 where there is no linear relation; a feature that never varies has no
    correlation.
    """
    spread = F.stddev_pop("value") * F.stddev_pop("contribution")
    r = attribution.groupBy("feature").agg(
        F.try_divide(F.covar_pop("value", "contribution"), spread).alias("correlation"))
    return r.withColumn("direction", F.coalesce(F.signum("correlation"), F.lit(0.0)).cast("int")).orderBy("feature")


def _pairs(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return (
        pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("guess"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))
