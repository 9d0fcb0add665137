"""The hash-drawn k-means|| start, silhouette from cluster sums, folds by batch folder, wide regression summaries."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from netsentry.functions import vectors as V
from netsentry.operators import cluster, regression, text
from netsentry.plans import standins as S
from netsentry.streaming import kmeans as SK
from conftest import SF0001


def points(spark, n=300, k=4, dim=3, seed=2):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)) + 8.0 * rng.integers(0, k, size=(n, 1))
    return data, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, x array<double>")


def test_start_is_the_same_in_any_partitioning(spark):
    _, df = points(spark)
    a = cluster.parallel_init(df.repartition(1), "id", "x", 4)
    assert a == cluster.parallel_init(df.repartition(9), "id", "x", 4) and len(a) == 4
    assert a != cluster.parallel_init(df, "id", "x", 4, seed=2)


def test_start_finds_separate_groups(spark):
    data, df = points(spark, k=4)
    fitted, costs = cluster.lloyd_fit(df, "x", cluster.parallel_init(df, "id", "x", 4, steps=3), 20)
    assert sorted(round(c[0] / 8) for c in fitted) == [0, 1, 2, 3]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def test_start_of_few_different_points(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(20)], "id long, x array<double>")
    assert sorted(cluster.parallel_init(df, "id", "x", 5)) == [[0.0], [1.0]]
    assert cluster.parallel_init(df.where("id < 0"), "id", "x", 5) == []


def test_silhouette_is_the_evaluators(spark):
    _, df = points(spark, n=120)
    centers = [[0.0] * 3, [8.0] * 3, [20.0] * 3, [1000.0] * 3]  # the last is nobody's
    got = cluster.silhouette(df, "x", centers).first()
    near = cluster.assign(df, "x", centers, "prediction").select(V.to_vector("x").alias("features"), "prediction")
    want = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(near)
    assert got["silhouette"] == pytest.approx(want, rel=1e-9) and got["n"] == 120
    assert got["wssse"] == pytest.approx(cluster.wssse(df, "x", centers).first()["wssse"])


def test_silhouette_of_single_points_and_one_cluster(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [9.0])], "id long, x array<double>")
    assert cluster.silhouette(df, "x", [[0.0], [9.0]]).first()["silhouette"] == pytest.approx(2 / 3)
    assert np.isnan(cluster.silhouette(df, "x", [[0.0]]).first()["silhouette"])
    assert cluster.silhouette(df.where("id > 5"), "x", [[0.0], [1.0]]).first()["n"] == 0


def test_random_centers_are_normal():
    centers, weights = cluster.random_centers(200, 50, 1.0, 3)
    c = np.array(centers)
    assert c.shape == (200, 50) and weights == [1.0] * 200
    assert abs(c.mean()) < 0.05 and abs(c.std() - 1) < 0.05 and len(np.unique(c)) == c.size


def test_fold_reads_one_folder_a_batch(spark, scratch):
    data, df = points(spark, n=90)
    rows = df.withColumn("b", F.pmod("id", F.lit(3)))
    stored = SK.numbered_store(rows, "b", scratch)
    plan = stored.where("b = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b" in plan
    start = SK.KMeansState.of(data[:2], [0.0, 0.0])
    out = f"{scratch}-out"
    trace = SK.kmeans_fold(rows.repartition(5), "x", "b", start, 0.9, batches=[0, 1, 5, 2], keep=["id"], out_path=out)
    state = start
    for number, got in trace:
        state = SK.kmeans_step(state, df.where(F.pmod("id", F.lit(3)) == number), "x", 0.9)
        assert np.allclose(state.centers, got.centers) and np.allclose(state.weights, got.weights)
        if number < 3:
            want = SK.predict(df.where(F.pmod("id", F.lit(3)) == number), "x", state).select("id", "cluster")
            assert sorted(map(tuple, want.collect())) == sorted(map(tuple, spark.read.parquet(f"{out}/b={number}").collect()))
    with pytest.raises(ValueError, match="without a batch number"):
        SK.kmeans_fold(spark.createDataFrame([(None, [1.0])], "b long, x array<double>"), "x", "b", start, 1.0)


def test_summaries_are_matrix_products(spark):
    rng = np.random.default_rng(1)
    x, y, b = rng.normal(size=(700, 64)), rng.normal(size=700), rng.integers(0, 300, 700)
    df = spark.createDataFrame([(int(n), v.tolist(), float(t)) for n, v, t in zip(b, x, y)], "b long, x array<double>, y double").repartition(3)
    rows = regression.batch_summaries(df, "x", "y", "b", 64).collect()
    assert len(rows) == len(set(b.tolist()))
    for r in rows:
        s = regression._summary(r["s"], 64)
        mine = b == r["_ns_b"]
        assert s.n == mine.sum() and np.allclose(s.xtx, x[mine].T @ x[mine]) and np.allclose(s.xty, x[mine].T @ y[mine])
    whole = regression.batch_summary(df, "x", "y", 64)
    assert whole.n == 700 and np.allclose(whole.xtx, x.T @ x)
    assert regression.batch_summary(df.where("b < 0"), "x", "y", 64).n == 0
    with pytest.raises(Exception, match="null"):
        regression.batch_summary(spark.createDataFrame([([1.0, None], 1.0)], "x array<double>, y double"), "x", "y", 2)


def test_synonyms_are_the_models(spark):
    toks = S.table(spark, SF0001, "documents", ["text"]).select(F.split("text", " ").alias("tokens"))
    model = text.word2vec("tokens", vector_size=8, min_count=20).fit(toks)
    word = text.vocabulary(toks, "tokens", 20).orderBy(F.desc("n")).first()["word"]
    got = [(r["word"], round(r["similarity"], 4)) for r in text.synonyms(model, word, 5).collect()]
    assert got == [(r["word"], round(r["similarity"], 4)) for r in model.findSynonyms(word, 5).orderBy(F.desc("similarity")).collect()]
    with pytest.raises(KeyError):
        text.synonyms(model, "no such word", 5)
