"""Prediction on a stream by a model that another query trains.

The training query commits a model version for each of its batches (``StreamingKMeans``,
``StreamingLinearRegression``). A predictor looks at each trigger of its own stream for the newest
committed version, reads it (k or d rows) and predicts the trigger's rows with it; a version that is
half-written is not seen. Each result row bears its version (null: the initial model), the predictions of trigger
``id`` go to ``<out>/batch=<id>``, and a trigger that was replayed after its predictions had been committed keeps
them, with the version of then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.operators import regression
from netsentry.sources import fs
from netsentry.streaming.kmeans import KMeansState, StateTable, predict
from netsentry.streaming.linreg import WeightTable


class _Predictor:
    table: type

    def __init__(self, state_path: str, out_path: str, keep: Sequence[str] = (), initial=None):
        self.state_path, self.out_path, self.keep, self.initial = state_path, out_path.rstrip("/"), list(keep), initial

    def newest(self, spark: SparkSession):
        """(version, model) of the newest committed version; (None, the initial model) before the first."""
        table = self.table(spark, self.state_path)
        versions = table.versions()
        if versions:
            return versions[-1], table.read(versions[-1])
        if self.initial is None:
            raise RuntimeError(f"no committed model version at {self.state_path} and no initial model")
        return None, self.initial

    def apply(self, rows: DataFrame, model) -> DataFrame:
        raise NotImplementedError

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        out = f"{self.out_path}/batch={int(batch_id)}"
        if fs.committed(spark, out):
            return
        version, model = self.newest(spark)
        self.apply(rows, model).withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(out)


class KMeansPredictor(_Predictor):
    """Rows to (``keep``, cluster, version)."""

    table = StateTable

    def __init__(self, state_path: str, out_path: str, vec_col: str = "features", keep: Sequence[str] = (), initial: KMeansState | None = None):
        super().__init__(state_path, out_path, keep, initial)
        self.vec_col = vec_col

    def apply(self, rows: DataFrame, model: KMeansState) -> DataFrame:
        return predict(rows, self.vec_col, model).select(*self.keep, "cluster")


class LinearPredictor(_Predictor):
    """Rows to (``keep``, prediction, version)."""

    table = WeightTable

    def __init__(self, state_path: str, out_path: str, features: str = "features", keep: Sequence[str] = (), initial: Sequence[float] | None = None):
        super().__init__(state_path, out_path, keep, initial)
        self.features = features

    def apply(self, rows: DataFrame, model: Sequence[float]) -> DataFrame:
        return rows.select(*self.keep, regression.linreg_predict(self.features, [float(x) for x in model]).alias("prediction"))
