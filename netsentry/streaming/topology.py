"""Two-hop online clustering.

Hop 1: raw record messages -> strict parse -> fitted pre-processing
pipeline -> ``timeStamp srcIp desIp vectorText`` messages on an intermediate
topic (here: a Parquet directory with a ``value`` column; Kafka takes the
same rows with ``format("kafka")``).

Hop 2: intermediate messages -> key/vector split -> streaming k-means:
train on the batch, publish the weights line, then publish
``key clusterId`` lines under the updated model.

Each hop is its own streaming query with its own checkpoint. Hop 1 is a
plain streaming transformation (the fitted pipeline transforms the stream
directly) into Spark's file sink, whose metadata log makes the hand-over
exactly-once: hop 2's file source reads only committed files. ``Hop1`` is
the ``foreachBatch`` form for sinks without that guarantee (a message bus),
where a replayed batch may be delivered twice.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.functions import parse as P
from netsentry.functions import records as R
from netsentry.functions import vectors as V
from netsentry.sources.files import MESSAGES_PER_FILE
from netsentry.streaming.kmeans import StreamingKMeans
from netsentry.streaming.scorer import parse_messages


def hop1_messages(batch: DataFrame, prehandler: PipelineModel, mode: str = "strict",
                  sparse: bool | str = "auto") -> DataFrame:
    """Record messages of one batch to intermediate ``value`` messages."""
    good, _ = parse_messages(batch, mode)
    scaled = prehandler.transform(good).select("timeStamp", "srcIp", "desIp", R.SCALED_FEATURES)
    arr = V.as_double_array(scaled, R.SCALED_FEATURES)
    return scaled.select(P.format_vector_message(["timeStamp", "srcIp", "desIp"], arr, sparse).alias("value"))


def hop1_stream(stream: DataFrame, prehandler: PipelineModel, mode: str = "strict",
                sparse: bool | str = "auto") -> DataFrame:
    """Hop 1 as a streaming DataFrame of ``value`` messages."""
    return hop1_messages(stream, prehandler, mode, sparse)


def start_hop1(stream: DataFrame, prehandler: PipelineModel, mid_path: str, checkpoint: str,
               trigger: dict | None = None, sparse: bool | str = "auto"):
    """Hop 1 into the exactly-once file sink at ``mid_path``, in files that hop 2's tasks can share."""
    w = hop1_stream(stream, prehandler, "strict", sparse).writeStream.format("parquet") \
        .option("path", mid_path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", MESSAGES_PER_FILE)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


class Hop1:
    def __init__(self, prehandler: PipelineModel, mid_path: str, mode: str = "strict",
                 sparse: bool | str = "auto"):
        self.pre, self.mid, self.mode, self.sparse = prehandler, mid_path.rstrip("/"), mode, sparse

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        hop1_messages(batch, self.pre, self.mode, self.sparse) \
            .write.mode("overwrite").parquet(f"{self.mid}/hop1_batch={int(batch_id)}")


def hop2_tagged(batch: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Intermediate messages as (keep, ``value``, ``key``, ``x``, ``reason``): the reason is null for
    a good message, ``no_key`` or ``bad_vector`` (a null ``x``) otherwise."""
    keep = keep or []
    kv = batch.select(*keep, "value", *P.split_key_vector("value", "key", "vt"))
    return kv.select(*keep, "value", "key", P.parse_vector("vt", "lenient").alias("x")).withColumn(
        "reason", F.when(F.col("key").isNull(), "no_key").when(F.col("x").isNull(), "bad_vector"))


def hop2_vectors(batch: DataFrame) -> DataFrame:
    """Intermediate messages to (key, x); a message without a key or a vector fails the job."""
    kv = batch.select(*P.split_key_vector("value", "key", "vt"), "value")
    key = F.coalesce("key", F.raise_error(F.concat(F.lit("not a keyed vector: "), F.coalesce("value", F.lit("<null>")))).cast("string"))
    return kv.select(key.alias("key"), P.parse_vector("vt").alias("x"))


class Hop2:
    """Streaming k-means on hop-2 vectors, keyed by the message key. With ``rejects_path``,
    messages that are no keyed vectors are written there per batch; without, they fail the job."""

    def __init__(self, model: StreamingKMeans, rejects_path: str | None = None):
        self.model, self.rejects = model, rejects_path and rejects_path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.rejects is None:
            self.model.foreach_batch(hop2_vectors(batch), batch_id)
            return
        tagged = hop2_tagged(batch).persist()  # parsed once for both outputs
        try:
            tagged.where("reason is not null").select("value", "reason").write.mode("overwrite").parquet(f"{self.rejects}/hop2_batch={int(batch_id)}")
            self.model.foreach_batch(tagged.where("reason is null").select("key", "x"), batch_id)
        finally:
            tagged.unpersist()


def assignment_lines(assignments: DataFrame) -> DataFrame:
    """``key clusterId`` message lines."""
    return assignments.select(P.format_assignment("key", "cluster").alias("value"))


def weight_lines(weights: DataFrame) -> DataFrame:
    """Comma-joined cluster weights per batch."""
    return weights.select("batch", P.format_weights("weights").alias("value"))
