"""The survival model: a random forest, its scores, and what its paths say about each row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.sources.scratch import scratch_path, scratch_root, stage

# Nodes that go to every task at once; a forest may have any number of such groups.
NODES_PER_GROUP = 1_000_000


def fit_survival_model(train: DataFrame, features: Sequence[str], label: str, num_trees: int = 150,
                       max_depth: int = 12, max_bins: int = 64, seed: int = 42) -> PipelineModel:
    """Fit a random forest with balanced class weights, n / (2 * rows of the class).

    Depth and bins are limited: candidate splits per node, and with them the
    memory of a training round, grow with both.
    """
    train.sparkSession.sparkContext.setCheckpointDir(scratch_root(train.sparkSession))
    weighted = with_class_weight(train, label).select(F.col(label).cast("double").alias("label"), "class_weight", *features)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="class_weight", numTrees=num_trees,
        maxDepth=max_depth, maxBins=max_bins, featureSubsetStrategy="sqrt", seed=seed,
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024,
    )
    return Pipeline(stages=[assembler, forest]).fit(weighted)


def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    """Add `class_weight` so that both classes weigh the same in total."""
    counts = train.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col(label) == 1).alias("n1")).alias("c")).scalar()
    of_class = F.when(F.col(label) == 1, counts["n1"]).otherwise(counts["n"] - counts["n1"])
    return train.withColumn("class_weight", counts["n"].cast("double") / (F.lit(2.0) * of_class))


def score_survival(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add `survival_prob` (class 1) and the predicted class `prediction`.

    A forest that was fitted without rows of class 1 knows class 0 alone; its `survival_prob` is 0.
    """
    scored = model.transform(df)
    return (
        scored.withColumn("survival_prob", _of_class_1(vector_to_array("probability")))
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def _of_class_1(values: Column) -> Column:
    """The second of a list by class, 0 where the list ends before it."""
    return F.coalesce(F.get(values, F.lit(1)), F.lit(0.0))


def model_importance(model: PipelineModel, spark) -> DataFrame:
    """`feature, importance` by impurity decrease, as the fitted forest reports it."""
    names, weights = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def forest_nodes(model: PipelineModel, spark) -> DataFrame:
    """`tree, node, feature, threshold, left, right, prob` of the fitted forest.

    Read from the saved model, which is a Parquet table of nodes; `prob` is the
    weighted share of class 1 among the training rows of the node.
    """
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    n = F.col("nodeData")
    survived = _of_class_1(n["impurityStats"])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.try_divide(survived, n["impurityStats"][0] + survived).alias("prob"),
    )


def path_attribution(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`event_id, feature, value, contribution, base_value` for every row; sample first to look at fewer.

    A row's path through a tree changes the class-1 share at every split; the change is credited to
    the feature of that split. Averaged over the trees, the contributions of a row and the base value
    add up to its predicted probability.

    Trees are put into groups of bounded size. Each group passes over the rows once, in batches, and adds
    to the credits that the rows carry; its arrays go to every task, and the next group starts from the
    written rows. Rows are not shuffled, and nodes are not joined with them.
    """
    spark = df.sparkSession
    names = list(model.stages[0].getInputCols())
    nodes = stage(forest_nodes(model, spark), "forest-nodes")
    groups, n_trees = tree_groups(nodes)
    base = nodes.filter("node = 0").agg(F.avg("prob")).first()[0]

    rows = df.select("event_id", F.array(*[F.col(c).cast("double") for c in names]).alias("values"),
                     F.array(*[F.lit(0.0) for _ in names]).alias("credits"))
    for group in range(max(groups.values()) + 1):
        if group:
            rows = stage(rows, "credited-rows")
        trees = _tree_arrays(nodes.filter(F.col("tree").isin([t for t, g in groups.items() if g == group])).toPandas())  # NODES_PER_GROUP rows at most
        rows = rows.mapInPandas(_walker(trees), rows.schema)
    credited = [F.struct(F.lit(c).alias("feature"), F.col("values")[i].alias("value"), (F.col("credits")[i] / F.lit(n_trees)).alias("contribution"))
                for i, c in enumerate(names)]
    return rows.select("event_id", F.inline(F.array(*credited))).withColumn("base_value", F.lit(base))


def tree_groups(nodes: DataFrame) -> tuple[dict[int, int], int]:
    """The group of each tree, and the number of trees. A tree above the bound is refused: limit its depth."""
    sizes = sorted((r["tree"], r["count"]) for r in nodes.groupBy("tree").count().collect())  # one row per tree
    groups, group, held = {}, 0, 0
    for tree, size in sizes:
        if size > NODES_PER_GROUP:
            raise ValueError(f"tree {tree} has {size} nodes, more than {NODES_PER_GROUP}")
        if held and held + size > NODES_PER_GROUP:
            group, held = group + 1, 0
        groups[tree] = group
        held += size
    return groups, len(sizes)


def _tree_arrays(table: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    trees = []
    for _, t in table.groupby("tree"):
        t = t.sort_values("node")
        trees.append({c: t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "prob")})
    return trees


def _walker(trees: list[dict[str, np.ndarray]]):
    """Move all rows of a batch down one level of a tree at a time, and add what their paths change to the credits."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            values, credit = (np.stack(rows[c].to_numpy()).astype("float64") for c in ("values", "credits"))
            every = np.arange(len(rows))
            for t in trees:
                at = np.zeros(len(rows), dtype="int64")
                moving = every[t["left"][at] >= 0]
                while len(moving):
                    here, split = at[moving], t["feature"][at[moving]]
                    goes_left = values[moving, split] <= t["threshold"][here]
                    there = np.where(goes_left, t["left"][here], t["right"][here])
                    credit[moving, split] += t["prob"][there] - t["prob"][here]
                    at[moving] = there
                    moving = moving[t["left"][there] >= 0]
            yield rows.assign(credits=list(credit))
    return walk
