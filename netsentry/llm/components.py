"""Connected components of an edge table, as Spark joins.

Large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each round is two aggregates and joins, every
edge ends at the smallest id of its component, and the number of rounds grows
with the logarithm of the longest path. Nothing but a count and a checksum of
the edges comes to the driver. Minimum per node is a partial aggregate, so a
node with very many edges costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import staged


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is joined to the least neighbour."""
    both = _both(edges)
    return (both.join(_minimum(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node, are joined to the least one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _minimum(down)
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node that has an edge to another
    node; ``component`` is the least id reachable. Nulls and self-edges are
    ignored, repeated edges count once, an empty table gives an empty table."""
    now = staged(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                 .where("a <> b").distinct(), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(now)
    while was[0]:
        now = staged(_small_star(_large_star(now)), "edges")
        if (got := state(now)) == was:
            break
        was = got
    return (now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
