"""Batch clustering.

Assignment and cost are native expressions over literal centres (see
``functions.vectors``); the per-cluster statistics of a Lloyd step are one
hash aggregate with a ``sum`` per slot, partially aggregated map-side, so
only k rows per partition cross the shuffle however many rows there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions import vectors as V


def kmeans(k: int, features: str = "features", prediction: str = "prediction", seed: int = 1,
           max_iter: int = 20, tol: float = 1e-4, init_mode: str = "k-means||", init_steps: int = 2) -> KMeans:
    """K-means estimator with the original job's settings."""
    return KMeans(k=k, featuresCol=features, predictionCol=prediction, seed=seed, maxIter=max_iter,
                  tol=tol, initMode=init_mode, initSteps=init_steps)


def centers_of(model) -> list[list[float]]:
    """k x dim centres of a fitted k-means model (k rows reach the driver)."""
    return [list(map(float, c)) for c in model.clusterCenters()]


def with_distances(df: DataFrame, vec: str, centers: Sequence[Sequence[float]],
                   out: str = "distanceToCentersVector", as_vector: bool = False, mode: str = "vectorized") -> DataFrame:
    """append squared distances to every centre (slot i = centre i)."""
    arr = V.as_double_array(df, vec)
    d = V.sq_distances(arr, centers, mode)
    return df.withColumn(out, V.to_vector(d) if as_vector else d)


def assign(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], out: str = "cluster",
           keep_distances: bool = False, dist_col: str = "_ns_d", mode: str = "vectorized") -> DataFrame:
    """M3: nearest centre (int, ties to the lowest id)."""
    if not keep_distances and mode == "vectorized":
        return df.withColumn(out, V.nearest_center_of(V.as_double_array(df, vec), centers))
    out_df = with_distances(df, vec, centers, dist_col, mode=mode).withColumn(out, V.nearest_center(dist_col))
    return out_df if keep_distances else out_df.drop(dist_col)


def cluster_cost(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], mode: str = "vectorized") -> DataFrame:
    """Per cluster: points and sum of squared distances to their centre."""
    d = with_distances(df.select(vec), vec, centers, "_ns_d", mode=mode)
    return d.select(V.nearest_center("_ns_d").alias("cluster"), F.array_min("_ns_d").alias("_ns_m")) \
        .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("_ns_m").alias("cost"))


def wssse(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], mode: str = "vectorized") -> DataFrame:
    """A3: one row, the sum over all points of the squared distance to the
    nearest centre (the old ``computeCost``), for any data, not only the
    training set."""
    d = with_distances(df.select(vec), vec, centers, "_ns_d", mode=mode)
    return d.agg(F.coalesce(F.sum(F.array_min("_ns_d")), F.lit(0.0)).alias("wssse"),
                  F.count(F.lit(1)).alias("n"))


def lloyd_stats(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], mode: str = "vectorized") -> DataFrame:
    """Per-cluster count and slot sums for the current centres: at most k
    rows (cluster, n, sums). Assignment runs per Arrow batch; the sums are a
    ``Summarizer`` aggregate, combined map-side, so the shuffle carries k rows
    per partition however many points (or however skewed the clusters) there
    are."""
    dim = len(centers[0])
    arr = V.as_double_array(df, vec)
    base = df.select(V.checked_width(arr, dim).alias("_ns_x"))
    near = V.nearest_center(V.sq_distances("_ns_x", centers, mode)) if mode in ("hof", "unrolled") \
        else V.nearest_center_of("_ns_x", centers)
    base = base.withColumn("cluster", near)
    return base.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), V.vector_sum("_ns_x").alias("_s")) \
        .select("cluster", "n", vector_to_array("_s").alias("sums"))


def lloyd_step(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], mode: str = "vectorized") -> DataFrame:
    """One Lloyd iteration as a DataFrame of (cluster, n, center).

    A cluster with no points keeps its centre (n = 0).
    """
    spark = df.sparkSession
    stats = lloyd_stats(df, vec, centers, mode)
    old = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                "cluster int, old array<double>")
    # k rows on each side: the statistics side is broadcast.
    joined = old.join(F.broadcast(stats), "cluster", "left")
    return joined.select(
        "cluster", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.when(F.col("n") > 0, F.transform("sums", lambda s: s / F.col("n"))).otherwise(F.col("old")).alias("center"))


def lloyd_fit(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], max_iter: int = 20,
              tol: float = 1e-4, mode: str = "vectorized", with_costs: bool = True) -> tuple[list[list[float]], list[float]]:
    """Plain Lloyd iterations from given centres; returns (centres, cost per
    iteration: another pass each, none ``with_costs=False``). Each iteration is one distributed aggregate; only k rows come
    back. The input is persisted once for the whole loop."""
    data = df.select(V.as_double_array(df, vec).alias("_ns_x")).persist()
    try:
        cur = [list(map(float, c)) for c in centers]
        costs = []
        for _ in range(max_iter):
            rows = lloyd_stats(data, "_ns_x", cur, mode).collect()
            new = [list(c) for c in cur]
            for r in rows:
                if r["n"] > 0:
                    new[r["cluster"]] = [x / r["n"] for x in r["sums"]]
            if with_costs:
                costs.append(wssse(data, "_ns_x", new, mode).first()["wssse"])
            shift = max(float(np.sum((np.array(a) - np.array(b)) ** 2)) for a, b in zip(cur, new))
            cur = new
            if shift <= tol * tol:
                break
        return cur, costs
    finally:
        data.unpersist()


def hash_uniform(key, draw: int, seed: int) -> Column:
    """A number in [0, 1) drawn for a row by its key: 52 bits of an md5, the same in any partitioning and engine."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("/", k.cast("string"), F.lit(str(draw)), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def parallel_init(df: DataFrame, key: str, vec: str, k: int, steps: int = 2, seed: int = 1, oversample: float = 2.0) -> list[list[float]]:
    """M1, the k-means|| start, drawn by a stable hash of each row's key.

    The first candidate is the row with the smallest draw. Each step then takes every row whose draw is below
    ``oversample * k * d2 / sum(d2)``, d2 its squared distance to the candidates so far: ``oversample * k`` rows are
    expected, whatever the number of rows, and one aggregate and one filter pass find them. All rows then weigh the candidates (one
    aggregate: rows nearest to each), and k candidates are chosen on the driver: the heaviest first, then the one with the greatest weight
    times squared distance to those chosen, ties to the candidate found first. Fewer than k come back if there are fewer
    different candidates. Equal keys draw alike; vectors must be of one width, a null vector or one of another width fails the job.
    """
    rows = df.select(F.col(key).alias("_ns_k"), V.as_double_array(df, vec).alias("_ns_x"))
    found = [list(r["_ns_x"]) for r in rows.orderBy(hash_uniform("_ns_k", 0, seed), "_ns_k").limit(1).collect()]
    for draw in range(1, steps + 1 if found else 0):
        far = rows.withColumn("_ns_d", F.array_min(V.sq_distances("_ns_x", found)))
        cost = far.agg(F.sum("_ns_d")).first()[0]
        if not cost:
            break
        drawn = far.where(hash_uniform("_ns_k", draw, seed) < F.lit(oversample * k) * F.col("_ns_d") / F.lit(cost))
        found += [list(r["_ns_x"]) for r in drawn.select("_ns_k", "_ns_x").orderBy("_ns_k").collect()]
    if not found:
        return []
    weight = np.zeros(len(found))
    for r in lloyd_stats(rows, "_ns_x", found).select("cluster", "n").collect():
        weight[r["cluster"]] = r["n"]
    points = np.array(found)
    chosen = [int(np.argmax(weight))]
    d2 = np.sum((points - points[chosen[0]]) ** 2, axis=1)
    while len(chosen) < k and (weight * d2).max() > 0:
        chosen.append(int(np.argmax(weight * d2)))
        d2 = np.minimum(d2, np.sum((points - points[chosen[-1]]) ** 2, axis=1))
    return [found[c] for c in chosen]


# --------------------------------------------------------------------- A5
def silhouette(df: DataFrame, vec: str, centers: Sequence[Sequence[float]]) -> DataFrame:
    """A5: (silhouette, wssse, n) of the assignment to the nearest centres, by squared distances.

    The mean squared distance of a point x to the points of a cluster of n points with sum S and sum of squares Q is
    ``|x - S/n|^2 + Q/n - |S/n|^2`` (times n / (n - 1) for its own cluster), so one aggregate of k rows and
    one more pass give it: no pair of points is formed. A point alone in its cluster counts 0;
    with one cluster the silhouette is NaN.
    """
    base = df.select(V.checked_width(V.as_double_array(df, vec), len(centers[0])).alias("_ns_x"))
    near = base.withColumn("cluster", V.nearest_center_of("_ns_x", centers))
    square = F.aggregate("_ns_x", F.lit(0.0), lambda a, x: a + x * x)
    rows = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), V.vector_sum("_ns_x").alias("s"), F.sum(square).alias("q")).orderBy("cluster").collect()
    if not rows:
        return df.sparkSession.createDataFrame([(float("nan"), 0.0, 0)], "silhouette double, wssse double, n long")
    means = [[float(x) / r["n"] for x in r["s"].toArray()] for r in rows]
    spread = [float(r["q"] / r["n"] - np.sum(np.square(m))) for r, m in zip(rows, means)]
    own = F.array(*[F.lit(r["cluster"]) for r in rows])
    mean_d = F.zip_with(V.sq_distances("_ns_x", means), F.array(*map(F.lit, spread)), lambda d, c: d + c)
    cost = F.array_min(V.sq_distances("_ns_x", centers))
    at = near.select(cost.alias("cost"), mean_d.alias("d"), F.array_position(own, F.col("cluster")).cast("int").alias("i"))
    size = F.element_at(F.array(*[F.lit(float(r["n"])) for r in rows]), F.col("i"))
    a = F.element_at("d", F.col("i")) * size / F.nullif(size - 1, F.lit(0.0))
    b = F.array_min(F.filter(F.transform("d", lambda x, j: F.when(j != F.col("i") - 1, x)), lambda x: x.isNotNull()))
    score = F.when(size == 1, F.lit(0.0)).when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    out = at.select("cost", (score if len(rows) > 1 else F.lit(float("nan"))).alias("s"))
    return out.agg(F.avg("s").alias("silhouette"), F.sum("cost").alias("wssse"), F.count(F.lit(1)).alias("n"))


def elbow_from_starts(df: DataFrame, vec: str, starts: dict[int, Sequence[Sequence[float]]], max_iter: int = 20, tol: float = 1e-4) -> DataFrame:
    """A5 over given starts: for each k, Lloyd iterations from ``starts[k]``, then cost and silhouette
    (k, wssse, silhouette)."""
    rows = []
    for k, centers in sorted(starts.items()):
        fitted, _ = lloyd_fit(df, vec, centers, max_iter, tol, with_costs=False)
        r = silhouette(df, vec, fitted).first()
        rows.append((int(k), r["wssse"], r["silhouette"]))
    return df.sparkSession.createDataFrame(rows, "k int, wssse double, silhouette double")


def elbow_sweep(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 1, max_iter: int = 20,
                parallelism: int = 4) -> DataFrame:
    """For each k: training cost (WSSSE) and silhouette. The input is
    persisted once (X2); the fits are independent, so up to ``parallelism``
    of them run as concurrent Spark jobs (as ``CrossValidator`` does), each
    one distributed; k rows per k come back."""
    from concurrent.futures import ThreadPoolExecutor

    spark = df.sparkSession
    arr = V.as_double_array(df, vec)
    data = df.select(V.to_vector(arr).alias("features")).persist()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                                    metricName="silhouette", distanceMeasure="squaredEuclidean")

    def one(k: int):
        model = kmeans(k, seed=seed, max_iter=max_iter).fit(data)
        sil = evaluator.evaluate(model.transform(data)) if k > 1 else float("nan")
        return int(k), float(model.summary.trainingCost), float(sil)

    try:
        data.count()  # materialise the cache once, before the concurrent fits
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(ks)))) as pool:
            out = list(pool.map(one, ks))
        return spark.createDataFrame(out, "k int, wssse double, silhouette double")
    finally:
        data.unpersist()


# -------------------------------------------------------------------- M10
def random_centers(k: int, dim: int, weight: float = 0.0, seed: int = 42) -> tuple[list[list[float]], list[float]]:
    """k standard-normal centres of width ``dim``, each with ``weight``: k x dim numbers made on the driver. Each is a
    Box-Muller draw from the md5 of ``cluster/slot/seed``, so that the centres of a seed are the same in any
    library version and engine."""
    def draw(cluster: int, slot: int) -> float:
        digest = hashlib.md5(f"{cluster}/{slot}/{seed}".encode()).hexdigest()
        u, v = (int(digest[13 * i:13 * i + 13], 16) / (1 << 52) for i in range(2))
        return math.sqrt(-2.0 * math.log(1.0 - u)) * math.cos(2.0 * math.pi * v)

    return [[draw(c, s) for s in range(dim)] for c in range(k)], [float(weight)] * k
