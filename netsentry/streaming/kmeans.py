"""Decayed streaming k-means.

Per micro-batch:

1. the batch is assigned to the current centres and reduced on executors to
   one row per cluster (count and a sum per slot) - a hash aggregate with
   map-side partial sums, so the shuffle carries at most k rows per task
   however large or skewed the batch is;
2. those k rows are merged into the k x dim model on the driver with the
   decay rule below (the only thing the driver ever holds);
3. the new model is written as version ``batch_id`` of a small state table in
   the shared folder, so a replayed batch reuses its version (idempotent) and
   a restarted query resumes from the last committed version.

Update rule, decay ``a`` (``unit="points"`` uses ``a ** points_in_batch``)::

    n   <- a * n                       (every cluster, even without points)
    w    = n + m;  l = m / max(w, 1e-16)
    c   <- (1 - l) * c + (l / m) * S    (clusters with m > 0)
    n   <- w
    if min(n) < 1e-8 * max(n): both get (max + min) / 2, and the lightest
    centre is moved next to the heaviest: x - p and x + p per slot with
    p = 1e-14 * max(|x|, 1).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.functions import vectors as V
from netsentry.operators.cluster import lloyd_stats
from netsentry.session import scratch_path
from netsentry.sources import fs
from netsentry.streaming.summary import SummarySink


def state_schema() -> T.StructType:
    """k rows per model version: cluster, weight, centre, time written, id of the streaming query that wrote it."""
    return T.StructType([
        T.StructField("cluster", T.IntegerType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("center", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("written_at", T.DoubleType(), True),
        T.StructField("query", T.StringType(), True),
    ])


@dataclass
class KMeansState:
    centers: np.ndarray  # k x dim
    weights: np.ndarray  # k

    @classmethod
    def of(cls, centers: Sequence[Sequence[float]], weights: Sequence[float]) -> "KMeansState":
        c = np.array(centers, dtype=float)
        w = np.array(weights, dtype=float)
        if c.ndim != 2 or len(w) != len(c):
            raise ValueError("need k centres of equal width and k weights")
        return cls(c, w)

    def copy(self) -> "KMeansState":
        return KMeansState(self.centers.copy(), self.weights.copy(), self.written_at, self.query)

    written_at: float | None = None  # processing time of the batch that made this version
    query: str | None = None  # the streaming query that made this version

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(w), [float(x) for x in c], self.written_at, self.query)
                for i, (c, w) in enumerate(zip(self.centers, self.weights))]
        return spark.createDataFrame(rows, state_schema())

    @classmethod
    def from_rows(cls, rows) -> "KMeansState":
        rows = sorted(rows, key=lambda r: r["cluster"])
        st = cls.of([r["center"] for r in rows], [r["weight"] for r in rows])
        if rows and "written_at" in rows[0].asDict():
            st.written_at = rows[0]["written_at"]
        if rows and "query" in rows[0].asDict():
            st.query = rows[0]["query"]
        return st


def merge(state: KMeansState, counts: dict[int, int], sums: dict[int, Sequence[float]],
          decay: float, unit: str = "batches") -> KMeansState:
    """Apply one batch's per-cluster (count, slot sums) to ``state``."""
    if unit not in ("batches", "points"):
        raise ValueError("unit must be batches or points")
    new = state.copy()
    a = decay if unit == "batches" else decay ** sum(counts.values())
    new.weights *= a
    for j, m in counts.items():
        if m <= 0:
            continue
        w = new.weights[j] + m
        lam = m / max(w, 1e-16)
        new.centers[j] = (1.0 - lam) * new.centers[j] + (lam / m) * np.asarray(sums[j], dtype=float)
        new.weights[j] = w
    hi = int(np.argmax(new.weights))
    lo = int(np.argmin(new.weights))
    if new.weights[lo] < 1e-8 * new.weights[hi]:
        half = (new.weights[hi] + new.weights[lo]) / 2.0
        new.weights[hi] = half
        new.weights[lo] = half
        x = new.centers[hi].copy()
        p = 1e-14 * np.maximum(np.abs(x), 1.0)
        new.centers[hi] = x + p
        new.centers[lo] = x - p
    return new


def batch_stats(batch: DataFrame, vec: str, state: KMeansState) -> tuple[dict, dict]:
    """Distributed per-cluster counts and slot sums of one batch (k rows)."""
    rows = lloyd_stats(batch, vec, state.centers.tolist()).collect()
    counts = {r["cluster"]: int(r["n"]) for r in rows}
    sums = {r["cluster"]: list(r["sums"]) for r in rows}
    return counts, sums


def kmeans_step(state: KMeansState, batch: DataFrame, vec: str, decay: float,
                unit: str = "batches") -> KMeansState:
    """M6: one model update from one batch."""
    counts, sums = batch_stats(batch, vec, state)
    return merge(state, counts, sums, decay, unit)


def numbered_store(df: DataFrame, batch_col: str, path: str) -> DataFrame:
    """``df`` written once below the shared folder, partitioned by its batch number, and read back: a step that asks for one batch
    reads that batch's folder only."""
    df.withColumn(batch_col, F.col(batch_col).cast("long")).write.partitionBy(batch_col).parquet(path)
    fields = [f for f in df.schema.fields if f.name != batch_col]
    return df.sparkSession.read.schema(T.StructType([*fields, T.StructField(batch_col, T.LongType())])).parquet(path)


def stored_numbers(spark: SparkSession, batch_col: str, path: str) -> list[int]:
    """The batch numbers of a store (its folder names; no pass over the data). Rows without a number are an error."""
    names = [n.partition("=")[2] for n in fs.list_dirs(spark, path) if n.startswith(f"{batch_col}=")]
    if any(not n.lstrip("-").isdigit() for n in names):
        raise ValueError("rows without a batch number")
    return sorted(map(int, names))


def kmeans_fold(df: DataFrame, vec: str, batch_col: str, state: KMeansState, decay: float,
                unit: str = "batches", batches: Sequence[int] | None = None, keep: Sequence[str] = (),
                out_path: str | None = None) -> list[tuple[int, KMeansState]]:
    """Replay micro-batches in ``batch_col`` order: [(batch, state after it)].

    The rows (``keep`` columns and the vector) are stored once by batch number; batches run one after another (the
    update is not commutative), each a distributed aggregate over its own folder. ``batches`` may name numbers without
    rows: empty batches, which decay the weights. With ``out_path`` the batch is read once more under the updated
    model and its assignments (``keep``, cluster) go to ``<out_path>/<batch_col>=<number>`` (train, then predict).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    data = numbered_store(df.select(batch_col, *keep, vec), batch_col, path)
    trace = []
    for b in stored_numbers(spark, batch_col, path) if batches is None else batches:
        rows = data.where(F.col(batch_col) == F.lit(int(b)))
        state = kmeans_step(state, rows, vec, decay, unit)
        trace.append((int(b), state))
        if out_path:
            predict(rows, vec, state).select(*keep, "cluster").write.mode("overwrite").parquet(f"{out_path}/{batch_col}={int(b)}")
    return trace


def trace_to_df(spark: SparkSession, trace, batch_name: str = "batch") -> DataFrame:
    """(batch, cluster, weight, center) rows of a fold trace."""
    rows = [(b, j, float(s.weights[j]), [float(x) for x in s.centers[j]])
            for b, s in trace for j in range(len(s.weights))]
    return spark.createDataFrame(rows, f"{batch_name} long, cluster int, weight double, center array<double>")


def predict(df: DataFrame, vec: str, state: KMeansState, out: str = "cluster") -> DataFrame:
    """M7/M8: nearest centre of the given model; other columns pass through."""
    arr = V.as_double_array(df, vec)
    return df.withColumn(out, V.nearest_center_of(arr, state.centers.tolist()))


def predict_versions(df: DataFrame, vec: str, version: str, states: dict[int, KMeansState], out: str = "cluster") -> DataFrame:
    """``predict`` of each row under the model version that its ``version`` column names, all versions in one pass; a version
    that is not there fails the job. The versions are k x dim numbers a micro-batch."""
    models = {v: s.centers.tolist() for v, s in states.items()}
    return df.withColumn(out, V.nearest_center_by(V.as_double_array(df, vec), F.col(version).cast("long"), models))


def weights_line(state: KMeansState) -> str:
    """The comma-joined cluster weights of a model."""
    return ",".join(repr(float(x)) for x in state.weights)


# ----------------------------------------------------------------- state table
class StateTable:
    """Versioned k-row model table: ``<path>/v=<batch_id>/`` (Parquet)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _version_path(self, version: int) -> str:
        return f"{self.path}/v={int(version)}"

    def versions(self) -> list[int]:
        out = []
        for name in fs.list_dirs(self.spark, self.path):
            if name.startswith("v=") and fs.committed(self.spark, f"{self.path}/{name}"):
                out.append(int(name[2:]))
        return sorted(out)

    def read(self, version: int) -> KMeansState:
        return KMeansState.from_rows(self.spark.read.parquet(self._version_path(version)).collect())

    def read_all(self) -> dict[int, KMeansState]:
        """Every committed version, by one read."""
        rows: dict[int, list] = {v: [] for v in self.versions()}
        if rows:
            tables = self.spark.read.option("basePath", self.path).parquet(*map(self._version_path, rows))
            for r in tables.withColumn("v", F.col("v").cast("long")).collect():
                rows[r["v"]].append(r)
        return {v: KMeansState.from_rows(r) for v, r in rows.items()}

    def latest_before(self, version: int) -> tuple[int | None, KMeansState | None]:
        # batch ids are consecutive: the previous version is normally there
        if version > 0 and self.has(version - 1):
            return version - 1, self.read(version - 1)
        older = [v for v in self.versions() if v < version]
        if not older:
            return None, None
        return older[-1], self.read(older[-1])

    def retain(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions (like Spark's own
        ``minBatchesToRetain``), so listings stay short on long streams."""
        vs = self.versions()
        for v in vs[:-keep] if keep > 0 else []:
            fs.delete(self.spark, self._version_path(v))

    def has(self, version: int) -> bool:
        return fs.committed(self.spark, self._version_path(version))

    def write(self, version: int, state: KMeansState) -> None:
        state.to_df(self.spark).coalesce(1).write.mode("overwrite").parquet(self._version_path(version))


def query_id(spark: SparkSession) -> str | None:
    """The id of the streaming query whose ``foreachBatch`` is running (kept in its checkpoint; None outside of one)."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def same_query(path: str, wrote: str | None, runs: str | None) -> None:
    """A version found for a batch must be the running query's own: after a checkpoint was reset, batch ids begin
    again, and models of the query before would be taken for replays."""
    if wrote and runs and wrote != runs:
        raise ValueError(f"the model versions at {path} are those of query {wrote}; give query {runs} a folder of its own")


class StreamingKMeans:
    """Online k-means driven by ``foreachBatch``.

    ``foreach_batch(df, batch_id)`` trains on the batch, then writes the
    weights line, then the batch's assignments under the updated model
    (train, publish, predict - the original order). Outputs go to
    ``<out>/weights/batch=<id>`` and ``<out>/assignments/batch=<id>`` with
    overwrite, so replays are idempotent.
    """

    def __init__(self, k: int, decay: float = 1.0, unit: str = "batches", *, state_path: str,
                 out_path: str | None = None, vec_col: str = "features", key_cols: Sequence[str] = (),
                 centers: Sequence[Sequence[float]] | None = None, weights: Sequence[float] | None = None,
                 dim: int | None = None, init_weight: float = 0.0, seed: int = 42,
                 tick_seconds: float | None = None, clock=time.time, retain_versions: int | None = None,
                 summary: SummarySink | None = None):
        from netsentry.operators.cluster import random_centers
        if centers is None:
            if dim is None:
                raise ValueError("give centres or a width for random centres")
            centers, weights = random_centers(k, dim, init_weight, seed)
        if weights is None:
            weights = [init_weight] * len(centers)
        self.initial = KMeansState.of(centers, weights)
        if len(self.initial.weights) != k:
            raise ValueError("k does not match the initial centres")
        self.decay, self.unit = decay, unit
        self.state_path, self.out_path = state_path, out_path
        self.vec_col, self.key_cols = vec_col, list(key_cols)
        self.tick_seconds, self.clock = tick_seconds, clock
        self.retain_versions = retain_versions
        self.summary = summary

    def current(self, spark: SparkSession, before: int | None = None) -> KMeansState:
        table = StateTable(spark, self.state_path)
        if before is None:
            vs = table.versions()
            return table.read(vs[-1]) if vs else self.initial
        _, st = table.latest_before(before)
        return st if st is not None else self.initial

    def missed_ticks_decayed(self, state: KMeansState, now: float) -> KMeansState:
        """Empty intervals: ``foreachBatch`` is not called when no data
        arrived, while the original decays the weights every interval. With
        ``tick_seconds`` set, the intervals missed since the last version
        (its stored processing time) are applied as ``decay ** missed``
        (batches unit; an empty interval has no points in the points unit)."""
        if not self.tick_seconds or state.written_at is None or self.unit != "batches":
            return state
        missed = int((now - state.written_at) // self.tick_seconds) - 1
        if missed <= 0:
            return state
        out = state.copy()
        out.weights = out.weights * (self.decay ** missed)
        return out

    def foreach_batch(self, batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        table = StateTable(spark, self.state_path)
        batch = batch_df.persist()
        try:
            if table.has(batch_id):  # replay after a failure: the model of this batch is already known
                state = table.read(batch_id)
                same_query(self.state_path, state.query, query_id(spark))
            else:
                now = self.clock()
                prev = self.missed_ticks_decayed(self.current(spark, before=batch_id), now)
                state = kmeans_step(prev, batch, self.vec_col, self.decay, self.unit)
                state.written_at, state.query = now, query_id(spark)
                table.write(batch_id, state)
                if self.retain_versions:
                    table.retain(self.retain_versions)
            if self.summary:
                self.summary.publish(spark, batch_id, weights_line(state))
            if self.out_path:
                w = spark.createDataFrame([(int(batch_id), weights_line(state),
                                            [float(x) for x in state.weights])],
                                          "batch long, weights_line string, weights array<double>")
                w.coalesce(1).write.mode("overwrite").parquet(f"{self.out_path}/weights/batch={int(batch_id)}")
                pred = predict(batch, self.vec_col, state).select(*self.key_cols, "cluster")
                pred.write.mode("overwrite").parquet(f"{self.out_path}/assignments/batch={int(batch_id)}")
        finally:
            batch.unpersist()
