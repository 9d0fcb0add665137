"""Message files that the tasks of a micro-batch can share, and rows checked under many model versions at once."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from netsentry.plans import stream_queries
from netsentry.sources import files
from netsentry.streaming import kmeans, topology
from netsentry.streaming.batches import Arrivals


def rows_by_file(path):
    return [pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]


def test_message_files_are_small(spark, tmp_path):
    n = 2 * files.MESSAGES_PER_FILE + 5
    df = spark.range(n).select(F.col("id").cast("string").alias("value"), F.lit(0).alias("batch")).coalesce(1)
    stream_queries._write_messages(df, f"{tmp_path}/source")
    Arrivals(df, "batch", f"{tmp_path}/arrivals")
    for path in ("source", "arrivals"):
        found = rows_by_file(f"{tmp_path}/{path}")
        assert len(found) >= 3 and max(found) <= files.MESSAGES_PER_FILE and sum(found) == n


def test_hop1_files_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topology, "hop1_stream", lambda stream, *_: stream)
    monkeypatch.setattr(topology, "MESSAGES_PER_FILE", 10)
    spark.range(25).select(F.col("id").cast("string").alias("value")).coalesce(1).write.parquet(f"{tmp_path}/source")
    stream = spark.readStream.schema("value string").parquet(f"{tmp_path}/source")
    topology.start_hop1(stream, None, f"{tmp_path}/mid", f"{tmp_path}/ck", {"availableNow": True}).awaitTermination()
    assert sorted(rows_by_file(f"{tmp_path}/mid")) == [5, 10, 10]


def test_versions_in_one_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    states = {v: kmeans.KMeansState.of(rng.normal(size=(4, 3)).tolist(), [1.0] * 4) for v in (0, 1, 7)}
    table = kmeans.StateTable(spark, f"{tmp_path}/state")
    assert table.read_all() == {}
    for v, state in states.items():
        table.write(v, state)
    read = table.read_all()
    assert set(read) == set(states) and all((read[v].centers == states[v].centers).all() for v in states)
    rows = [(i, [0, 1, 7][i % 3], rng.normal(size=3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, batch int, x array<double>")
    got = {r["i"]: r["cluster"] for r in kmeans.predict_versions(df, "x", "batch", read).collect()}
    want = {r["i"]: r["cluster"] for v in states for r in kmeans.predict(df.where(F.col("batch") == v), "x", states[v]).collect()}
    assert got == want and len(set(want.values())) > 1
