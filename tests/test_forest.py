"""The hash-drawn forest against trees grown in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsentry.operators import forest


def data(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 50, size=(n, 5)).astype(float)
    y = (x[:, 0] > 20).astype(int) + (x[:, 1] > 35) * (x[:, 2] < 10)
    rows = [(f"k{i}", v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "key string, x array<double>, y int")


def gini(w):
    return 1 - ((w / w.sum()) ** 2).sum()


def grown(x, y, weight, tree, trees, depth, bins, seed, classes):
    cuts = [[lo + (hi - lo) * j / bins for j in range(1, bins)] for lo, hi in zip(x.min(0), x.max(0))]

    def grow(rows, node):
        total = np.bincount(y[rows], weight[rows], classes)
        options = []
        if node < 1 << depth:
            for f in forest.node_features(tree, node, x.shape[1], forest.subset_size(x.shape[1], trees), seed):
                for c in cuts[f]:
                    left = rows[x[rows, f] <= c]
                    lw = np.bincount(y[left], weight[left], classes)
                    rw = total - lw
                    if lw.sum() and rw.sum():
                        gain = gini(total) - (lw.sum() * gini(lw) + rw.sum() * gini(rw)) / total.sum()
                        if gain > 1e-12:
                            options.append((-round(gain, 12), f, c))
        if not options:
            return {node: ("leaf", total.tolist())}
        _, f, c = min(options)
        return {node: (f, c)} | grow(rows[x[rows, f] <= c], 2 * node) | grow(rows[x[rows, f] > c], 2 * node + 1)

    return grow(np.arange(len(x)), 1)


@pytest.mark.parametrize("trees,cells", [(1, 1 << 23), (4, 1 << 23), (4, 1)])
def test_forest_is_the_plain_one(spark, monkeypatch, trees, cells):
    monkeypatch.setattr(forest, "HELD_CELLS", cells)  # with one: a pass for each node
    x, y, df = data(spark)
    fitted = forest.fit_forest(df.repartition(6), "key", "x", "y", 3, 5, trees, 3, 16, seed=9)
    drawn = df.select("key", *(forest.tree_weight("key", t, 9).alias(f"w{t}") for t in range(trees))).collect()
    by_key = {r["key"]: r for r in drawn}
    for t in range(trees):
        weight = np.array([by_key[f"k{i}"][f"w{t}"] if trees > 1 else 1 for i in range(len(x))], float)
        want = grown(x, y, weight, t, trees, 3, 16, 9, 3)
        got = {n: s for n, s in fitted.splits[t].items()} | {n: ("leaf", w) for n, w in fitted.leaves[t].items()}
        assert got == want
    again = forest.fit_forest(df.repartition(1), "key", "x", "y", 3, 5, trees, 3, 16, seed=9)
    assert (again.splits, again.leaves) == (fitted.splits, fitted.leaves)


def test_sample_weights_are_poisson(spark):
    w = np.array([r[0] for r in spark.range(20000).select(forest.tree_weight("id", 1, 5)).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def test_saved_forest_predicts_alike(spark, scratch):
    x, y, df = data(spark)
    fitted = forest.fit_forest(df, "key", "x", "y", 3, 5, 10, 5, 32)
    fitted.to_df(spark).write.parquet(scratch)
    loaded = forest.Forest.from_df(spark.read.parquet(scratch))
    got = np.array([r[0] for r in df.select(forest.predict("x", loaded)).collect()])
    assert (got == np.argmax(fitted.shares(x), axis=1)).all()
    assert (got == y).mean() > 0.95 > np.bincount(y).max() / len(y)


def test_one_tree_splits_where_the_library_does(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector
    rows = [(f"k{i}", [float(i % 10), float(i // 10)], int(i % 10 > 6)) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, x array<double>, y int")
    own = forest.fit_forest(df, "key", "x", "y", 2, 2, 1, 1, 18)
    tree = DecisionTreeClassifier(maxDepth=1).fit(df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")))
    assert own.splits[0][1][0] == 0 and 6 <= own.splits[0][1][1] < 7
    assert f"feature {own.splits[0][1][0]} <= 6.5" in tree.toDebugString


@pytest.mark.parametrize("bad", [([1.0, float("nan")], 0), ([1.0, None], 0), ([1.0], 0), (None, 0), ([1.0, 2.0], 7), ([1.0, 2.0], None)])
def test_bad_rows_fail(spark, bad):
    df = spark.createDataFrame([("a", [0.0, 1.0], 1), ("b", *bad)], "key string, x array<double>, y int")
    with pytest.raises(Exception):
        forest.fit_forest(df, "key", "x", "y", 2, 2, 2, 2, 4)


def test_few_rows(spark):
    df = spark.createDataFrame([("a", [0.0], 1)] * 3, "key string, x array<double>, y int")
    fitted = forest.fit_forest(df, "key", "x", "y", 2, 1, 5, 3, 4)
    assert all(not s for s in fitted.splits)
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_forest(df.where("y = 0"), "key", "x", "y", 2, 1)
