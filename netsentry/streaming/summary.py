"""Summary lines of a model, one for each batch.

The line is a few numbers that the driver already holds, so it is written by the driver: one
small file for each batch id, made beside its place and moved there. A replayed batch
writes the same file again, so a reader finds one line for each batch. On a message bus the same line goes out as a frame of one row
with ``kafka_sink_options``, where a replay may send it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.sources import files, fs


class SummarySink:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def publish(self, spark: SparkSession, batch_id: int, line: str) -> None:
        if "\n" in line:
            raise ValueError("a summary is one line")
        fs.write_text(spark, f"{self.path}/{int(batch_id)}.txt", line + "\n")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The published lines as (batch, value)."""
    lines = files.read_text(spark, f"{path.rstrip('/')}/*.txt", "\n")
    return lines.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("long").alias("batch"), "value")
