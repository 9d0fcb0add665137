"""The two-stage classification plan.

Stage 1: index + one-hot the symbolic columns, assemble, index the label,
scale, k-means. Between the stages: squared distance to every k-means centre
appended as a vector (a native expression over the k centres, inlined as
literals). Stage 2: assemble scaled features + distances + cluster id,
random forest, predicted index back to the label string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame

from netsentry.functions import records as R
from netsentry.operators import classify, cluster, features
from netsentry.sources import models


def stage1_pipeline(symbolic: Sequence[str], assembler_inputs: Sequence[str], label: str | None = "label",
                    k: int | None = 23, seed: int = 1, handle_invalid: str = "error") -> Pipeline:
    stages = features.feature_pipeline(symbolic, assembler_inputs, label, handle_invalid).getStages()
    if k:
        stages.append(cluster.kmeans(k, features=R.SCALED_FEATURES, prediction=R.KMEANS_PREDICTION, seed=seed))
    return Pipeline(stages=stages)


def stage1_centers(model: PipelineModel) -> list[list[float]]:
    return cluster.centers_of(features.find_stage(model, KMeansModel))


def append_distances(df: DataFrame, centers: Sequence[Sequence[float]], as_vector: bool = True) -> DataFrame:
    """F7 on the scaled features: ``distanceToCentersVector`` (slot i = centre i)."""
    return cluster.with_distances(df, R.SCALED_FEATURES, centers, R.DISTANCE_TO_CENTERS, as_vector=as_vector)


def stage2_pipeline(labels: Sequence[str], num_trees: int = 10, max_depth: int = 5, seed: int = 1) -> Pipeline:
    return Pipeline(stages=[
        features.assembler([R.SCALED_FEATURES, R.DISTANCE_TO_CENTERS, R.KMEANS_PREDICTION], R.ASSEMBLED_FEATURES),
        classify.random_forest(num_trees=num_trees, max_depth=max_depth, seed=seed),
        features.index_to_label(R.RF_PREDICTION, labels, R.PREDICTED_LABEL),
    ])


def fit_two_stage(train: DataFrame, symbolic: Sequence[str], assembler_inputs: Sequence[str], k: int,
                  split_key: str, weights=(0.7, 0.3), seed: int = 1, path1: str | None = None,
                  path2: str | None = None):
    """Fit (or load) both stages; returns (model1, model2, scored test rows).

    The train/test split is a stable hash of ``split_key``, so a reloaded
    stage 2 never scores its own training rows. K-means and forest read their input several times: the
    columns they use are kept on disk meanwhile, in the partitions they have, so that the steps before them
    run once and no memory is taken from their own caches.
    """
    spark = train.sparkSession
    *before, clusters = stage1_pipeline(symbolic, assembler_inputs, "label", k, seed).getStages()
    m1 = models.load_if_saved(spark, path1) if path1 else None
    fitted = m1.stages[:-1] if m1 else Pipeline(stages=before).fit(train).stages
    rows = PipelineModel(stages=fitted).transform(train).select(split_key, R.SCALED_FEATURES, R.INDEXED_LABEL).persist(StorageLevel.DISK_ONLY)
    kept = None
    try:
        if m1 is None:
            # a selection, not the kept frame itself: k-means then caches its vectors for its iterations
            m1 = PipelineModel(stages=[*fitted, clusters.fit(rows.select(R.SCALED_FEATURES))])
            if path1:
                models.save(m1, path1)
        p2 = stage2_pipeline(features.labels_of(m1, R.INDEXED_LABEL), seed=seed)
        m2 = models.load_if_saved(spark, path2) if path2 else None
        if m2 is None:
            near = append_distances(features.find_stage(m1, KMeansModel).transform(rows), stage1_centers(m1))
            tr = features.hash_split(near, split_key, list(weights))[0]
            kept = tr.select(R.SCALED_FEATURES, R.DISTANCE_TO_CENTERS, R.KMEANS_PREDICTION, R.INDEXED_LABEL).persist(StorageLevel.DISK_ONLY)
            kept.count()  # by all tasks; the first look at a row would else compute a whole partition in one
            m2 = p2.fit(kept)
            if path2:
                models.save(m2, path2)
    finally:
        rows.unpersist()
        if kept is not None:
            kept.unpersist()
    staged = append_distances(m1.transform(train), stage1_centers(m1))
    return m1, m2, m2.transform(features.hash_split(staged, split_key, list(weights))[1])


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` (a folder in the shared checkpoint dir) and
    read it back: the result no longer depends on the lineage (or on any
    persisted input) that produced it, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def score(df: DataFrame, m1: PipelineModel, m2: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """T4 core: stage 1, distances, stage 2, then ``keep`` + predicted label.
    A missing ``label`` column is fine: the label indexer skips itself."""
    s1 = m1.transform(df)
    s2 = m2.transform(append_distances(s1, stage1_centers(m1)))
    return s2.select(*keep, R.PREDICTED_LABEL)
