import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsentry.functions import vectors as V
from netsentry.operators import cluster


@pytest.fixture()
def pts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    return spark.createDataFrame(rows, "id long, x array<double>"), rows


@pytest.mark.parametrize("mode", ["vectorized", "hof", "unrolled"])
def test_distances_match_numpy(spark, pts, mode):
    df, rows = pts
    centers = [[0.0] * 6, [1.0] * 6, [-1.0, 2.0, 0.5, 0.0, 3.0, -2.0]]
    got = {r["id"]: r["d"] for r in df.select("id", V.sq_distances("x", centers, mode).alias("d")).collect()}
    c = np.array(centers)
    for i, x in rows:
        want = ((np.array(x)[None, :] - c) ** 2).sum(1)
        assert np.allclose(got[i], want, rtol=1e-12, atol=1e-12)


def test_nearest_ties_go_to_lowest_index(spark):
    df = spark.createDataFrame([([1.0],), ([5.0],), ([9.0],)], "x array<double>")
    centers = [[0.0], [2.0], [10.0], [8.0]]  # 1.0 is equally far from 0 and 2
    got = [r[0] for r in cluster.assign(df, "x", centers).select("cluster").collect()]
    assert got == [0, 1, 2]
    got_hof = [r[0] for r in cluster.assign(df, "x", centers, mode="hof").select("cluster").collect()]
    assert got_hof == got


def test_nearest_vectorized_matches_native(spark, pts):
    df, _ = pts
    centers = np.random.default_rng(1).normal(size=(12, 6)).tolist()  # 72 terms: numpy path
    a = df.select("id", V.nearest_center_of("x", centers).alias("a"),
                  V.nearest_center(V.sq_distances("x", centers, "hof")).alias("b"))
    assert a.filter(F.col("a") != F.col("b")).count() == 0


def test_width_mismatch_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    with pytest.raises(Exception):
        cluster.lloyd_stats(df, "x", [[0.0, 0.0, 0.0]]).collect()


def test_cosine_and_dot(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [round(r[0], 12) for r in df.select(V.cosine_similarity("a", "b")).collect()]
    assert got == [0.0, 1.0, 0.0]
    assert [r[0] for r in df.select(V.dot_literal("a", [2.0, 3.0])).collect()] == [2.0, 5.0, 0.0]


@pytest.mark.parametrize("dim", [1, 7, 48, 49, 64])
def test_one_contract_in_every_mode(spark, dim):
    centers = [[0.0] * dim, [1.0] * dim]
    nan = [float("nan")] + [1.0] * (dim - 1)
    good = spark.createDataFrame([(0, [1.0] * dim), (1, nan), (2, [None] + nan[1:])], "id int, x array<double>").orderBy("id")
    for mode in ("vectorized", "hof", "unrolled"):
        rows = [r[0] for r in good.select(V.sq_distances("x", centers, mode)).collect()]
        assert rows[0] == [float(dim), 0.0] and all(math.isnan(d) for r in rows[1:] for d in r), mode
        assert [r[0] for r in good.select(V.nearest_center(V.sq_distances("x", centers, mode))).collect()] == [1, 0, 0]
        for bad in (None, [1.0] * (dim - 1), [1.0] * (dim + 1)):
            with pytest.raises(Exception, match="vector width must be"):
                spark.createDataFrame([(bad,)], "x array<double>").select(V.sq_distances("x", centers, mode)).collect()
    assert [r[0] for r in good.select(V.nearest_center_of("x", centers)).collect()] == [1, 0, 0]
    for bad in (None, [1.0] * (dim - 1), [1.0] * (dim + 1)):
        with pytest.raises(Exception, match="vector width must be"):
            spark.createDataFrame([(bad,)], "x array<double>").select(V.nearest_center_of("x", centers)).collect()
