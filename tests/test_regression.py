import numpy as np
from pyspark.sql import functions as F

from netsentry.operators import regression


def _brute(w, X, y, step=0.1, iters=50, tol=0.001):
    """Explicit per-row gradient descent, the definition."""
    prev = None
    for t in range(1, iters + 1):
        g = np.zeros_like(w)
        for xi, yi in zip(X, y):
            g += (xi @ w - yi) * xi
        w = w - step / np.sqrt(t) * g / len(y)
        if prev is not None and np.linalg.norm(prev - w) < tol * max(np.linalg.norm(w), 1.0):
            break
        prev = w
    return w


def test_summary_sgd_equals_row_gd(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(x.tolist(), float(v), i % 3) for i, (x, v) in enumerate(zip(X, y))],
                               "x array<double>, y double, b int")
    for tol in (0.0, 0.001):
        w = regression.linreg_step([0.0, 0.0, 0.0], df, "x", "y", tol=tol)
        assert np.allclose(w, _brute(np.zeros(3), X, y, tol=tol), rtol=1e-10, atol=1e-12)
    trace = regression.linreg_fold(df, "x", "y", "b", [0.0, 0.0, 0.0])
    w = np.zeros(3)
    for b in range(3):
        m = np.arange(200) % 3 == b
        w = _brute(w, X[m], y[m])
    assert np.allclose(trace[-1][1], w, rtol=1e-10, atol=1e-12)


def test_empty_batch_keeps_weights(spark):
    df = spark.createDataFrame([], "x array<double>, y double")
    assert list(regression.linreg_step([1.0, 2.0], df, "x", "y")) == [1.0, 2.0]


def test_predict(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert df.select(regression.linreg_predict("x", [0.5, 0.25])).first()[0] == 1.0


def test_streaming_linreg_equals_fold(spark, scratch):
    from netsentry.streaming.linreg import StreamingLinearRegression
    rng = np.random.default_rng(4)
    X = rng.normal(size=(90, 2))
    y = X @ np.array([2.0, -1.0])
    rows = [(x.tolist(), float(v)) for x, v in zip(X, y)]
    m = StreamingLinearRegression([0.0, 0.0], state_path=f"{scratch}/w", out_path=f"{scratch}/o",
                                  features="x", label="y")
    for b in range(3):
        m.foreach_batch(spark.createDataFrame(rows[b * 30:(b + 1) * 30], "x array<double>, y double"), b)
    w = np.zeros(2)
    for b in range(3):
        w = _brute(w, X[b * 30:(b + 1) * 30], y[b * 30:(b + 1) * 30])
    assert np.allclose(m.weights_before(spark, 99), w)
    assert spark.read.parquet(f"{scratch}/o/predictions").count() == 90
