"""Online linear regression by full-batch SGD (M11, M12) over micro-batches.

Per batch one aggregate (X'X, X'y, n) runs on executors; the SGD steps run
on that d x d summary; the weights are kept as versions of a small table in
the shared folder (``<state>/v=<batch_id>``), so replays are idempotent and
restarts resume. Like the original's output order (train, then predict),
the batch's predictions use the weights after training on it; they are
keyed by the true label and written to ``<out>/predictions/batch=<id>``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.operators import regression
from netsentry.sources import fs
from netsentry.streaming.kmeans import query_id, same_query


class WeightTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _p(self, v: int) -> str:
        return f"{self.path}/v={int(v)}"

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in fs.list_dirs(self.spark, self.path)
                      if n.startswith("v=") and fs.committed(self.spark, f"{self.path}/{n}"))

    def has(self, v: int) -> bool:
        return fs.committed(self.spark, self._p(v))

    def read(self, v: int, query: str | None = None) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(self._p(v)).collect(), key=lambda r: r["slot"])
        if rows:
            same_query(self.path, rows[0].asDict().get("query"), query)
        return np.array([r["weight"] for r in rows])

    def write(self, v: int, w: np.ndarray, query: str | None = None) -> None:
        self.spark.createDataFrame([(i, float(x), query) for i, x in enumerate(w)], "slot int, weight double, query string") \
            .coalesce(1).write.mode("overwrite").parquet(self._p(v))


class StreamingLinearRegression:
    def __init__(self, initial_weights: Sequence[float], *, state_path: str, out_path: str | None = None,
                 features: str = "features", label: str = "label", step: float = 0.1, iterations: int = 50,
                 tol: float = 0.001):
        self.w0 = np.array(initial_weights, dtype=float)
        self.state_path, self.out_path = state_path, out_path
        self.features, self.label = features, label
        self.step, self.iterations, self.tol = step, iterations, tol

    def weights_before(self, spark: SparkSession, batch_id: int) -> np.ndarray:
        t = WeightTable(spark, self.state_path)
        if batch_id > 0 and t.has(batch_id - 1):  # consecutive batch ids: no listing
            return t.read(batch_id - 1)
        older = [v for v in t.versions() if v < batch_id]
        return t.read(older[-1]) if older else self.w0.copy()

    def foreach_batch(self, batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        t = WeightTable(spark, self.state_path)
        batch = batch_df.persist()
        try:
            if t.has(batch_id):  # replay: this batch's weights are known
                w = t.read(batch_id, query_id(spark))
            else:
                prev = self.weights_before(spark, batch_id)
                w = regression.linreg_step(prev, batch, self.features, self.label, self.step,
                                           self.iterations, self.tol)
                t.write(batch_id, w, query_id(spark))
            if self.out_path:
                batch.select(F.col(self.label).cast("double").alias("label"),
                             regression.linreg_predict(self.features, w.tolist()).alias("prediction")) \
                    .write.mode("overwrite").parquet(f"{self.out_path}/predictions/batch={int(batch_id)}")
        finally:
            batch.unpersist()
