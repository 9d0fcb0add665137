"""Random forest whose draws are hashes (M4, M5), grown from class histograms.

The library's forest (``operators.classify``) draws its samples and feature subsets from a
generator, so no other engine can repeat it. Here a row's weight in a tree (Poisson with mean 1, as
the library's bootstrap) is drawn from a hash of its key, a node's features from a hash of tree, node
and feature, and splits are chosen by whole numbers: the same rows give the same forest in any partitioning, run or engine.

Growing is level by level. The rows are written once as bytes (a bin for each feature, the class, a
weight for each tree). For each level every task routes its rows through the trees so far and counts
(node, feature, bin, class) by matrix sums; one aggregate adds up an array for each (tree, node), and only these
histograms (trees x nodes x features x bins x classes numbers, whatever the number of rows) reach the driver, which picks
each node's split.

A split sends values up to its threshold left. It is the one with the greatest sum of squared class weights over
weight, left plus right (the least Gini impurity), ties to the lower feature, then the lower
threshold; a node is a leaf where no split lowers the impurity, both sides must have weight, and at ``max_depth``. A prediction adds up the trees' class shares; ties go
to the lower class. Null vectors or labels, vectors of another width and NaN components fail the job; an empty table is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from netsentry.functions import vectors as V
from netsentry.operators.cluster import hash_uniform
from netsentry.session import scratch_path

#: Numbers of the histograms that a task (and the driver) holds at once; a level of more nodes takes several passes.
HELD_CELLS = 1 << 23

#: Upper ends of the draws of weights 0, 1, 2, ...: the distribution of a Poisson variable with mean 1.
POISSON = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@dataclass
class Forest:
    """``splits[tree][node]`` = (feature, threshold); the children of node n are 2n and 2n + 1, the root is 1.
    ``leaves[tree][node]`` = class weights of a leaf."""

    classes: int
    width: int
    splits: list[dict[int, tuple[int, float]]] = field(default_factory=list)
    leaves: list[dict[int, list[float]]] = field(default_factory=list)
    gains: list[dict[int, float]] = field(default_factory=list)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the class shares of each row's leaf."""
        out = np.zeros((len(x), self.classes))
        for splits, leaves in zip(self.splits, self.leaves):
            node = route(splits, x)
            for n, weights in leaves.items():
                out[node == n] += np.array(weights) / (sum(weights) or 1.0)
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A row for each node: a saved forest is this frame as a table."""
        rows = [(t, n, f, x, self.gains[t][n], None) for t, s in enumerate(self.splits) for n, (f, x) in s.items()]
        rows += [(t, n, None, None, None, w) for t, s in enumerate(self.leaves) for n, w in s.items()]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, gain double, weights array<double>") \
            .withColumns({"classes": F.lit(self.classes), "width": F.lit(self.width)})

    @classmethod
    def from_df(cls, nodes: DataFrame) -> "Forest":
        rows = nodes.collect()
        out = cls(rows[0]["classes"], rows[0]["width"])
        trees = 1 + max(r["tree"] for r in rows)
        out.splits, out.leaves, out.gains = ([{} for _ in range(trees)] for _ in range(3))
        for r in rows:
            if r["weights"] is None:
                out.splits[r["tree"]][r["node"]] = (r["feature"], r["threshold"])
                out.gains[r["tree"]][r["node"]] = r["gain"]
            else:
                out.leaves[r["tree"]][r["node"]] = list(r["weights"])
        return out


def route(splits: dict[int, tuple[int, float]], x: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    node = np.ones(len(x), np.int64)
    for n in sorted(splits):
        feature, threshold = splits[n]
        here = node == n
        node[here] = 2 * n + (x[here, feature] > threshold)
    return node


def subset_size(width: int, trees: int) -> int:
    """The automatic feature subset: all for one tree, else the square root."""
    return width if trees == 1 else math.ceil(math.sqrt(width))


def node_features(tree: int, node: int, width: int, size: int, seed: int) -> list[int]:
    """The features a node may split by: those with the smallest hashes."""
    def draw(feature: int) -> str:
        return hashlib.md5(f"{tree}/{node}/{feature}/{seed}".encode()).hexdigest()

    return sorted(sorted(range(width), key=lambda f: (draw(f), f))[:size])


def tree_weight(key, tree: int, seed: int) -> Column:
    """How often a row stands in a tree's sample."""
    u = hash_uniform(key, tree, seed)
    return sum((F.when(u >= end, 1).otherwise(0) for end in POISSON), F.lit(0))


def equal_width_cuts(df: DataFrame, vec: str, width: int, bins: int) -> list[list[float]]:
    """``bins - 1`` thresholds for each feature, evenly spaced between its least and greatest value (one aggregate)."""
    x = V.checked_width(V.as_double_array(df, vec), width)
    row = df.select(x.alias("x")).agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if row["lo0"] is None:
        raise ValueError("no rows to learn from")
    return [[row[f"lo{i}"] + (row[f"hi{i}"] - row[f"lo{i}"]) * j / bins for j in range(1, bins)] for i in range(width)]


def _binned(cuts: list[list[float]]):
    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        if x.null_count or flat.null_count:
            raise ValueError("a vector or a component is null")
        values = flat.to_numpy().reshape(-1, len(cuts))
        if np.isnan(values).any():
            raise ValueError("a component is not a number")
        bins = np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pa.array([b.tobytes() for b in bins], pa.binary())

    return arrow_udf(run, "binary")


def _histograms(splits: list[dict[int, tuple[int, float]]], open_: list[tuple[int, int]], width: int, bins: int, classes: int):
    """Arrow batches (bins, y, w) to rows (tree, node, h): the class weights of each (feature, bin) of the open (tree, node)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {of: np.zeros(width * bins * classes) for of in open_}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, width).astype(np.int64)
            y = batch["y"].to_numpy()
            weights = np.frombuffer(b"".join(batch["w"].to_pylist()), np.uint8).reshape(n, len(splits))
            cell = (np.arange(width) * bins + x) * classes + y[:, None]
            for t in {t for t, _ in open_}:
                node = route(splits[t], x)
                for k in (k for of, k in open_ if of == t):
                    here = (node == k) & (weights[:, t] > 0)
                    held[t, k] += np.bincount(cell[here].ravel(), np.repeat(weights[here, t], width), len(held[t, k]))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.int32()), pa.array([k for _, k in held], pa.int32()),
                                          pa.array([h.tolist() for h in held.values()], pa.list_(pa.float64()))], ["tree", "node", "h"])

    return run


def best_split(h: np.ndarray, features: Sequence[int]) -> tuple[int, int, float] | None:
    """(feature, cut, gain) from class weights h[feature, bin, class]; None: no split lowers the impurity."""
    total = h[0].sum(axis=0)
    weight, square = total.sum(), (total * total).sum()
    best, found = square / weight if weight else 0.0, None
    for f in features:
        left = np.cumsum(h[f], axis=0)[:-1]
        right = total - left
        wl, wr = left.sum(axis=1), right.sum(axis=1)
        both = (wl > 0) & (wr > 0)
        score = np.where(both, (left * left).sum(axis=1) / np.maximum(wl, 1) + (right * right).sum(axis=1) / np.maximum(wr, 1), -1.0)
        k = int(np.argmax(score)) if len(score) else 0
        if len(score) and score[k] > best:
            best, found = float(score[k]), (f, k)
    return None if found is None else (*found, float(best / weight - square / (weight * weight)))


def fit_forest(df: DataFrame, key: str, vec: str, label: str, classes: int, width: int, trees: int = 10, max_depth: int = 5, bins: int = 32,
               seed: int = 1) -> Forest:
    """M4: a forest from rows of (key, vector, class number from 0). ``bins`` is at most 256."""
    spark = df.sparkSession
    cuts = equal_width_cuts(df, vec, width, bins)
    weights = [tree_weight(key, t, seed) if trees > 1 else F.lit(1) for t in range(trees)]
    x = V.checked_width(V.as_double_array(df, vec), width)
    packed = F.concat(*[F.unhex(F.lpad(F.hex(w), 2, "0")) for w in weights])
    y = F.col(label).cast("int")
    checked = F.when(y.between(0, classes - 1), y).otherwise(F.raise_error("a class is not a number below the number of classes").cast("int"))
    path = scratch_path(spark, "forest-rows")
    df.select(_binned(cuts)(x).alias("bins"), checked.alias("y"), packed.alias("w")).write.parquet(path)
    rows = spark.read.parquet(path)
    out = Forest(classes, width, [{} for _ in range(trees)], [{} for _ in range(trees)], [{} for _ in range(trees)])
    by_bin: list[dict[int, tuple[int, float]]] = [{} for _ in range(trees)]
    open_ = [(t, 1) for t in range(trees)]
    at_once = max(1, HELD_CELLS // (width * bins * classes))
    for depth in range(max_depth + 1):
        level, open_, made = open_, [], []
        for lo in range(0, len(level), at_once):
            sums = rows.mapInArrow(_histograms(by_bin, level[lo:lo + at_once], width, bins, classes), "tree int, node int, h array<double>")
            for r in sums.groupBy("tree", "node").agg(V.vector_sum("h").alias("h")).collect():
                t, n, h = r["tree"], r["node"], r["h"].toArray().reshape(width, bins, classes)
                found = best_split(h, node_features(t, n, width, subset_size(width, trees), seed)) if depth < max_depth else None
                if found is None:
                    out.leaves[t][n] = h[0].sum(axis=0).tolist()
                else:
                    made.append((t, n, *found))
        for t, n, feature, cut, gain in made:  # after the whole level: its passes route by the trees above it
            by_bin[t][n], out.splits[t][n], out.gains[t][n] = (feature, cut), (feature, cuts[feature][cut]), gain
            open_ += [(t, 2 * n), (t, 2 * n + 1)]
    return out


def predict(vec, forest: Forest) -> Column:
    """M5: the class number of each vector."""
    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        if x.null_count or flat.null_count:
            raise ValueError("a vector or a component is null")
        return pa.array(np.argmax(forest.shares(flat.to_numpy().reshape(-1, forest.width)), axis=1).astype(np.int32))

    return arrow_udf(run, "int")(V.checked_width(vec, forest.width))
