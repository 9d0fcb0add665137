"""Micro-batch jobs.

``foreachBatch`` hands each micro-batch over as a plain DataFrame, so the
fitted pipelines (whose vector stages need batch DataFrames) run unchanged
and every write can be keyed by the batch id: a replayed batch overwrites
its own output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netsentry.functions import parse as P
from netsentry.functions import records as R
from netsentry.plans import pipelines


def start(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
          trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Run ``handler(batch_df, batch_id)`` per micro-batch.

    ``trigger`` is passed to ``DataStreamWriter.trigger`` (default: every
    5 seconds; ``{"availableNow": True}`` drains what is there and stops).
    The checkpoint (in the shared folder) records which batches are done.
    """
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(**(trigger or {"processingTime": "5 seconds"}))
    return w.start()


def parse_messages(batch: DataFrame, mode: str = "lenient", value: str = "value"):
    """P1 + P2/P3 on a batch of messages: (records, rejects)."""
    lines = P.explode_records(batch.select(value), value, "line", None)
    return P.parse_records(lines, R.stream_record_schema(), "line", mode)


def tag_messages(batch: DataFrame, value: str = "value") -> DataFrame:
    """P1 + P3 on a batch of messages: every record with its line and the reason it is no record (null: it is one)."""
    return P.parse_records(P.explode_records(batch.select(value), value, "line", None), R.stream_record_schema(), "line", "tagged")[0]


class Scorer:
    """T4: messages -> lenient parse -> stage 1 -> distances -> stage 2 ->
    (timeStamp, srcIp, desIp, predictedLabel), written per batch to
    ``<out>/scored/batch=<id>``; rejected lines to ``<out>/rejects/batch=<id>``.
    An optional ``sink(df, batch_id)`` replaces the Parquet sink (e.g. JDBC)."""

    def __init__(self, m1: PipelineModel, m2: PipelineModel, out_path: str,
                 keep: Sequence[str] = ("timeStamp", "srcIp", "desIp"),
                 sink: Callable[[DataFrame, int], None] | None = None):
        self.m1, self.m2, self.out = m1, m2, out_path.rstrip("/")
        self.keep, self.sink = list(keep), sink

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        def to_parquet(scored: DataFrame, batch_id: int) -> None:
            scored.write.mode("overwrite").parquet(f"{self.out}/scored/batch={int(batch_id)}")

        write = self.sink or to_parquet
        tagged = tag_messages(batch).persist()  # parsed once, for rows and for rejects
        try:
            good, rejects = P.split_tagged(tagged, R.stream_record_schema())
            if not good.isEmpty():
                write(pipelines.score(good, self.m1, self.m2, self.keep), batch_id)
            elif self.sink is None:  # P14: nothing to score; the batch's folder is written all the same, typed and empty
                fields = [*(good.schema[c] for c in self.keep), T.StructField(R.PREDICTED_LABEL, T.StringType())]
                write(batch.sparkSession.createDataFrame([], T.StructType(fields)), batch_id)
            rejects.write.mode("overwrite").parquet(f"{self.out}/rejects/batch={int(batch_id)}")
        finally:
            tagged.unpersist()


def score_stream(stream: DataFrame, m1: PipelineModel, m2: PipelineModel, out_path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    return start(stream, Scorer(m1, m2, out_path), checkpoint, trigger)
