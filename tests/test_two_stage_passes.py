"""Passes of the two-stage fit over its input."""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from netsentry.functions import records as R
from netsentry.plans import pipelines


def test_forest_fit_computes_stage_one_and_distances_once(spark, monkeypatch):
    n = 400
    rows = spark.range(n, numPartitions=2).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"),
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
        F.when(F.col("id") % 17 > 8, "high.").otherwise("low.").alias("label"))
    seen = spark.sparkContext.accumulator(0)
    real = pipelines.append_distances

    def counted(df, centers, as_vector=True):
        def see(v):
            seen.add(1)
            return v

        return real(df, centers, as_vector).withColumn(R.DISTANCE_TO_CENTERS, F.udf(see, VectorUDT())(R.DISTANCE_TO_CENTERS))

    monkeypatch.setattr(pipelines, "append_distances", counted)
    _, _, scored = pipelines.fit_two_stage(rows, ["s"], ["x", "s_Vec", "y"], 3, "key")
    assert 0 < seen.value <= n
    assert scored.where(F.col("label") == F.col(R.PREDICTED_LABEL)).count() == scored.count() > 0
