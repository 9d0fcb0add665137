import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsentry.streaming import kmeans as SK
from conftest import SF001


def _df(spark, pts):
    return spark.createDataFrame([(list(map(float, p)),) for p in pts], "x array<double>")


def test_hand_checked_update(spark):
    st = SK.KMeansState.of([[0, 0], [10, 10]], [1, 1])
    st = SK.kmeans_step(st, _df(spark, [(1, 1), (2, 2), (9, 9)]), "x", 0.5)
    assert np.allclose(st.centers, [[1.2, 1.2], [28 / 3, 28 / 3]])
    assert np.allclose(st.weights, [2.5, 1.5])
    empty = spark.createDataFrame([], "x array<double>")
    st = SK.kmeans_step(st, empty, "x", 0.5)
    assert np.allclose(st.weights, [1.25, 0.75])


def test_dying_cluster_is_split(spark):
    st = SK.KMeansState.of([[0.0], [100.0]], [1.0, 0.0])
    st = SK.kmeans_step(st, _df(spark, [(1,), (2,)]), "x", 1.0)
    assert np.allclose(st.weights, [1.5, 1.5])
    assert st.centers[0][0] == 1.0 + 1e-14 and st.centers[1][0] == 1.0 - 1e-14


def test_points_unit(spark):
    st = SK.KMeansState.of([[0.0], [10.0]], [4.0, 4.0])
    st = SK.kmeans_step(st, _df(spark, [(1,), (9,)]), "x", 0.5, unit="points")
    assert np.allclose(st.weights, [2.0, 2.0])  # 4 * 0.5^2 + 1


def test_fold_over_events(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.pmod("event_id", F.lit(3)).alias("b"), F.array("value").alias("x"))
    trace = SK.kmeans_fold(ev, "x", "b", SK.KMeansState.of([[0.0], [50.0]], [0.0, 0.0]), 0.95)
    st = trace[-1][1]
    assert [round(c[0], 6) for c in st.centers] == [17.963742, 86.836985]
    assert [round(w, 3) for w in st.weights] == [5140.64, 4367.645]


def test_matches_mllib_update(spark):
    from pyspark.mllib.clustering import StreamingKMeansModel
    from pyspark.mllib.linalg import Vectors
    rng = np.random.default_rng(5)
    batches = [rng.normal(size=(50, 3)) + rng.integers(0, 3) * 4 for _ in range(4)]
    init = rng.normal(size=(3, 3))
    ref = StreamingKMeansModel(init.tolist(), [1.0, 1.0, 1.0])
    st = SK.KMeansState.of(init, [1.0, 1.0, 1.0])
    for b in batches:
        ref = ref.update(spark.sparkContext.parallelize([Vectors.dense(r) for r in b]), 0.8, "batches")
        st = SK.kmeans_step(st, _df(spark, b.tolist()), "x", 0.8)
    assert np.allclose(np.array(ref.centers), st.centers, rtol=1e-10, atol=1e-12)
    assert np.allclose(ref.clusterWeights, st.weights, rtol=1e-12)


def test_foreach_batch_stream_equals_fold_and_replays(spark, scratch):
    """One file per micro-batch, distinct mtimes: the stream's final model
    equals the batch fold; replaying a batch id reuses its stored version."""
    from netsentry.sources import kafka
    from netsentry.streaming import scorer
    rng = np.random.default_rng(11)
    batches = [rng.normal(size=(40, 2)) * 3 + (i * 2) for i in range(3)]
    src = f"{scratch}/src"
    for i, b in enumerate(batches):
        p = f"{src}/part-{i}"
        _df(spark, b.tolist()).withColumn("k", F.monotonically_increasing_id()).coalesce(1) \
            .write.parquet(p + "-tmp")
        # one file per batch, oldest first
        f = [n for n in os.listdir((p + "-tmp").replace("file:", "")) if n.endswith(".parquet")][0]
        os.makedirs(src.replace("file:", ""), exist_ok=True)
        dst = f"{src.replace('file:', '')}/b{i}.parquet"
        os.link(f"{(p + '-tmp').replace('file:', '')}/{f}", dst)
        os.utime(dst, (time.time() - 100 + i * 10, time.time() - 100 + i * 10))
    init = [[0.0, 0.0], [5.0, 5.0]]
    model = SK.StreamingKMeans(2, 0.9, state_path=f"{scratch}/state", out_path=f"{scratch}/out",
                               vec_col="x", key_cols=["k"], centers=init, weights=[0.0, 0.0])
    stream = kafka.read_stream(spark, kafka.file_source(src, schema="x array<double>, k long",
                                                        max_files_per_trigger=1))
    q = scorer.start(stream, model.foreach_batch, f"{scratch}/ck", {"availableNow": True})
    q.awaitTermination()
    streamed = model.current(spark)
    fold = SK.KMeansState.of(init, [0.0, 0.0])
    for b in batches:
        fold = SK.kmeans_step(fold, _df(spark, b.tolist()), "x", 0.9)
    assert np.allclose(streamed.centers, fold.centers) and np.allclose(streamed.weights, fold.weights)
    w = spark.read.parquet(f"{scratch}/out/weights").orderBy("batch").collect()
    assert len(w) == 3 and w[-1]["weights_line"] == ",".join(repr(float(x)) for x in fold.weights)
    assert spark.read.parquet(f"{scratch}/out/assignments").count() == 120
    # replay of batch 2: same version reused, state unchanged
    model.foreach_batch(_df(spark, batches[2].tolist()).withColumn("k", F.lit(0)), 2)
    again = model.current(spark)
    assert np.allclose(again.centers, fold.centers)


def test_missed_ticks_decay(spark, scratch):
    """With tick_seconds, intervals without data still decay the weights."""
    now = [1000.0]
    model = SK.StreamingKMeans(2, 0.5, state_path=f"{scratch}/state", vec_col="x",
                               centers=[[0.0], [10.0]], weights=[1.0, 1.0], tick_seconds=1.0,
                               clock=lambda: now[0])
    model.foreach_batch(_df(spark, [(1,), (9,)]), 0)         # weights 0.5 + 1 = 1.5 each
    assert np.allclose(model.current(spark).weights, [1.5, 1.5])
    now[0] = 1003.0                                           # two empty ticks missed
    model.foreach_batch(_df(spark, [(1,)]), 1)               # 1.5 * 0.25 * 0.5 + 1, 1.5 * 0.25 * 0.5
    assert np.allclose(model.current(spark).weights, [1.1875, 0.1875])
    replay = SK.StreamingKMeans(2, 0.5, state_path=f"{scratch}/state", vec_col="x",
                                centers=[[0.0], [10.0]], weights=[1.0, 1.0])
    replay.foreach_batch(_df(spark, [(1,)]), 1)              # replay reuses the stored version
    assert np.allclose(replay.current(spark).weights, [1.1875, 0.1875])


def test_state_retention(spark, scratch):
    model = SK.StreamingKMeans(2, 0.5, state_path=f"{scratch}/state", vec_col="x",
                               centers=[[0.0], [10.0]], weights=[1.0, 1.0], retain_versions=2)
    for b in range(4):
        model.foreach_batch(_df(spark, [(1,), (9,)]), b)
    table = SK.StateTable(spark, f"{scratch}/state")
    assert table.versions() == [2, 3]
    fold = SK.KMeansState.of([[0.0], [10.0]], [1.0, 1.0])
    for _ in range(4):
        fold = SK.kmeans_step(fold, _df(spark, [(1,), (9,)]), "x", 0.5)
    assert np.allclose(model.current(spark).weights, fold.weights)
