"""Random forest and accuracy (M4, M5, A4)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions import records as R


def random_forest(features: str = R.ASSEMBLED_FEATURES, label: str = R.INDEXED_LABEL,
                  prediction: str = R.RF_PREDICTION, num_trees: int = 10, max_depth: int = 5,
                  max_bins: int = 32, seed: int = 1) -> RandomForestClassifier:
    """The original forest: 10 trees, depth 5, 32 bins, gini, full subsample,
    automatic feature subset; plus an explicit seed."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, predictionCol=prediction,
                                  numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins,
                                  impurity="gini", subsamplingRate=1.0, featureSubsetStrategy="auto",
                                  seed=seed)


def accuracy_expr(label, prediction) -> Column:
    lc = F.col(label) if isinstance(label, str) else label
    pc = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.avg((lc == pc).cast("double"))


def accuracy(df: DataFrame, label: str = R.INDEXED_LABEL, prediction: str = R.RF_PREDICTION) -> DataFrame:
    """A4: one row (accuracy, test_error, n); one aggregate."""
    return df.agg(accuracy_expr(label, prediction).alias("accuracy"), F.count(F.lit(1)).alias("n")) \
        .withColumn("test_error", 1.0 - F.col("accuracy"))
