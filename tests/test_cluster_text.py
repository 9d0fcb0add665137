import numpy as np
from pyspark.sql import functions as F

from netsentry.functions import parse as P
from netsentry.operators import cluster, text
from conftest import SF001

# kmeans_data.txt: (v, v, v) for v in 0.0 0.1 0.2 9.0 9.1 9.2
KMEANS_LINES = ["0.0 0.0 0.0", "0.1 0.1 0.1", "0.2 0.2 0.2", "9.0 9.0 9.0", "9.1 9.1 9.1", "9.2 9.2 9.2"]


def test_kmeans_sample_wssse(spark):
    df = spark.createDataFrame([(l,) for l in KMEANS_LINES], "value string") \
        .select(P.parse_dense_vector("value").alias("x"))
    from netsentry.functions.vectors import to_vector
    model = cluster.kmeans(2, seed=1).fit(df.select(to_vector("x").alias("features")))
    centers = cluster.centers_of(model)
    assert round(cluster.wssse(df, "x", centers).first()["wssse"], 6) == 0.12
    fitted, costs = cluster.lloyd_fit(df, "x", [[0.0] * 3, [9.2] * 3])
    assert round(costs[-1], 6) == 0.12
    assert all(b <= a + 1e-12 for a, b in zip(costs, costs[1:]))


def test_elbow_and_fit_invariants(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    sweep = cluster.elbow_sweep(emb, "embedding", [2, 4], seed=1).orderBy("k").collect()
    assert sweep[0]["wssse"] >= sweep[1]["wssse"] > 0
    assert all(-1 <= r["silhouette"] <= 1 for r in sweep)


def test_top_similar_brute_force(spark):
    rng = np.random.default_rng(8)
    V = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(V)], "id long, v array<double>")
    got = [r["id"] for r in text.top_similar(df, "id", "v", 7, 4).collect()]
    sims = V @ V[7] / (np.linalg.norm(V, axis=1) * np.linalg.norm(V[7]))
    order = [i for i in np.argsort(-sims, kind="stable") if i != 7][:4]
    assert got == order


def test_word2vec_sample(spark):
    lines = ["1 2 6 0 2 3 1 1 0 0 3", "1 3 0 1 3 0 0 2 0 0 1", "1 4 1 0 0 4 9 0 1 2 0",
             "2 1 0 3 0 0 5 0 2 3 9", "3 1 1 9 3 0 2 0 0 1 3", "4 2 0 3 4 5 1 1 1 4 0",
             "2 1 0 3 0 0 5 0 2 2 9", "1 1 1 9 2 1 2 0 0 1 3", "4 4 0 3 4 2 1 3 0 0 0",
             "2 8 2 0 3 0 2 0 2 7 2", "1 1 1 9 0 2 2 0 0 3 3", "4 1 0 0 4 5 1 3 0 1 0"]
    df = spark.createDataFrame([(l,) for l in lines], "text string").select(P.tokenize("text").alias("tokens"))
    model = text.word2vec("tokens", seed=1).fit(df)
    words = {r["word"] for r in model.getVectors().collect()}
    vocab = {r["word"] for r in text.vocabulary(df, "tokens", 5).collect()}
    assert words == vocab
    syn = text.synonyms(model, "1", 5).collect()
    assert len(syn) == 5 and all(r["word"] != "1" for r in syn)


def test_stochastic_fit_invariants(spark):
    """Forest and k-means fits: whole outputs, ids in range, and the forest
    beats always guessing the majority class."""
    import __spark_entry__ as E
    q = E.queries()
    km = q["kmeans_fit"](spark, SF001)
    n_emb = spark.read.parquet(f"{SF001}/embeddings.parquet").count()
    assert km.count() == n_emb
    assert {r[0] for r in km.select("cluster").distinct().collect()} <= set(range(5))
    rf = q["rf_fit_score"](spark, SF001)
    rows = rf.collect()
    acc = sum(r["label"] == r["predictedLabel"] for r in rows) / len(rows)
    counts = {}
    for r in rows:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert acc > max(counts.values()) / len(rows)
