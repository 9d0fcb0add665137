"""Vectors and labelled points from text streams.

Lines come in the column ``value`` (``files.stream_text`` or a message bus). Each parser takes and
gives a streaming or a batch frame, so it runs in front of a training or predicting handler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.functions import parse as P


def vectors(lines: DataFrame) -> DataFrame:
    """Vector lines as (features); a line that is no vector fails the query."""
    return lines.select(P.parse_vector("value").alias("features"))


def tagged_vectors(lines: DataFrame) -> DataFrame:
    """(value, features, reason): the reason is null for a vector, ``bad_vector`` otherwise."""
    out = lines.select("value", P.parse_vector("value", "lenient").alias("features"))
    return out.withColumn("reason", F.when(F.col("features").isNull(), "bad_vector"))


def labeled_points(lines: DataFrame) -> DataFrame:
    """Labelled point lines as (label, features); a line that is none fails the query."""
    return lines.select(P.parse_labeled_point("value").alias("p")).select("p.label", "p.features")


def tagged_points(lines: DataFrame) -> DataFrame:
    """(value, label, features, reason): the reason is null for a labelled point, else ``bad_label`` or ``bad_vector``."""
    out = lines.select("value", P.parse_labeled_point("value", "lenient").alias("p")).select("value", "p.label", "p.features")
    return out.withColumn("reason", F.when(F.col("label").isNull(), "bad_label").when(F.col("features").isNull(), "bad_vector"))


class TaggedSink:
    """Good lines and rejects of each batch to ``<out>/good/batch=<id>`` and ``<out>/rejects/batch=<id>``, parsed once."""

    def __init__(self, tag, out: str):
        self.tag, self.out = tag, out.rstrip("/")

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        tagged = self.tag(lines).persist()
        try:
            tagged.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{self.out}/good/batch={int(batch_id)}")
            tagged.where("reason is not null").select("value", "reason").write.mode("overwrite").parquet(f"{self.out}/rejects/batch={int(batch_id)}")
        finally:
            tagged.unpersist()
