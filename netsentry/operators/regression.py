"""Linear regression by full-batch gradient descent.

With the whole batch in every step (mini-batch fraction 1.0), the gradient
sum over the batch is ``sum((w.x - y) x) = (X'X) w - X'y``. So one
distributed aggregate per batch - an array of d*(d+1)/2 + d + 1 sums, partially
aggregated map-side - replaces the T passes over the data; the T steps then
run on the d x d summary on the driver.

Step t = 1..T: ``w -= step / sqrt(t) * ((X'X) w - X'y) / n``; no intercept,
no regularisation; from t = 2 on, stop when
``|w_t - w_(t-1)| < tol * max(|w_t|, 1)``. Empty batches leave ``w`` alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions import vectors as V


@dataclass
class Summary:
    n: int
    xtx: np.ndarray  # d x d
    xty: np.ndarray  # d


#: Batches whose partial summaries a task holds before it sends them on.
HELD_BATCHES = 256


def _partial_summaries(dim: int):
    """Arrow batches (b, x, y) to rows (b, s): n, X'y and the upper triangle of X'X of a task's rows of each batch, as one array."""
    upper = np.triu_indices(dim)

    def rows(held: dict) -> pa.RecordBatch:
        values = [np.concatenate([[n], xy, xx[upper]]) for n, xx, xy in held.values()]
        size = np.arange(len(values) + 1, dtype=np.int32) * (1 + dim + len(upper[0]))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(values)))], ["b", "s"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            b, y, x = batch["b"].to_numpy(), batch["y"], batch["x"].flatten()
            if y.null_count or x.null_count:
                raise ValueError("a label or a component of a vector is null")
            x, y = x.to_numpy().reshape(-1, dim), y.to_numpy()
            for number in np.unique(b).tolist():
                mine = b == number
                xs, ys = x[mine], y[mine]
                n, xx, xy = held.get(number, (0, 0.0, 0.0))
                held[number] = n + len(xs), xx + xs.T @ xs, xy + xs.T @ ys
            if len(held) >= HELD_BATCHES:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def _summary(values: Sequence[float], dim: int) -> Summary:
    values = np.asarray(values)
    xtx = np.zeros((dim, dim))
    xtx[np.triu_indices(dim)] = values[1 + dim:]
    return Summary(int(round(values[0])), xtx + np.triu(xtx, 1).T, values[1:1 + dim].copy())


def batch_summaries(df: DataFrame, vec: str, label: str, batch_col: str, dim: int) -> DataFrame:
    """One summary (``_ns_b``, ``s``) per batch number, ``s`` being n, X'y and the upper triangle of X'X as one array of
    1 + d + d(d+1)/2 numbers. Each task sums its Arrow batches by matrix products and sends one array a batch; the arrays are
    added up by an aggregate with map-side partial sums. A null label or component fails the job."""
    arr = V.as_double_array(df, vec)
    base = df.select(F.col(batch_col).cast("long").alias("b"), V.checked_width(arr, dim).alias("x"), F.col(label).cast("double").alias("y"))
    parts = base.mapInArrow(_partial_summaries(dim), "b long, s array<double>")
    return parts.groupBy(F.col("b").alias("_ns_b")).agg(V.vector_sum("s").alias("s")).select("_ns_b", vector_to_array("s").alias("s"))


def batch_summary(df: DataFrame, vec: str, label: str, dim: int) -> Summary:
    """The whole frame as one batch; a single row comes back (none: an empty batch)."""
    row = batch_summaries(df.withColumn("_ns_one", F.lit(0)), vec, label, "_ns_one", dim).first()
    return _summary(row["s"], dim) if row else Summary(0, np.zeros((dim, dim)), np.zeros(dim))


def sgd_on_summary(w: np.ndarray, s: Summary, step: float = 0.1, iterations: int = 50,
                   tol: float = 0.001) -> np.ndarray:
    w = np.array(w, dtype=float)
    if s.n == 0:
        return w
    prev = None
    for t in range(1, iterations + 1):
        grad = (s.xtx @ w - s.xty) / s.n
        w = w - (step / np.sqrt(t)) * grad
        if prev is not None and np.linalg.norm(prev - w) < tol * max(np.linalg.norm(w), 1.0):
            break
        prev = w
    return w


def linreg_step(weights: Sequence[float], batch: DataFrame, vec: str, label: str, step: float = 0.1,
                iterations: int = 50, tol: float = 0.001) -> np.ndarray:
    """Weights after training on one batch."""
    w = np.array(weights, dtype=float)
    return sgd_on_summary(w, batch_summary(batch, vec, label, len(w)), step, iterations, tol)


def linreg_fold(df: DataFrame, vec: str, label: str, batch_col: str, weights: Sequence[float],
                step: float = 0.1, iterations: int = 50, tol: float = 0.001) -> list[tuple[object, np.ndarray]]:
    """Replay batches in order; [(batch, weights after it)].

    All batch summaries come from ONE grouped aggregate (grouped by batch,
    partial sums map-side), since a summary does not depend on the weights;
    only the cheap d x d iterations run in batch order.
    """
    dim = len(weights)
    rows = batch_summaries(df, vec, label, batch_col, dim).orderBy("_ns_b").collect()
    w = np.array(weights, dtype=float)
    trace = []
    for r in rows:
        w = sgd_on_summary(w, _summary(r["s"], dim), step, iterations, tol)
        trace.append((r["_ns_b"], w.copy()))
    return trace


def linreg_predict(vec, weights: Sequence[float]) -> Column:
    """``w . x`` with literal weights (codegen arithmetic); a vector of
    another width than the weights fails the job."""
    return V.dot_literal(V.checked_width(vec, len(weights)), weights)
