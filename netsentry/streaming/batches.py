"""Micro-batches that are numbered by their rows.

A trigger admits what has arrived, up to a cap of bytes, so one logical batch may come in
several triggers and one trigger may hold the end of one batch and the beginning of the
next. ``NumberedBatches`` keeps the rows in a folder for each batch number below the shared folder, and
hands a batch to its handler when a row of a later batch has come (or ``finish`` says that there are no more): the
handler sees each logical batch whole, in order and once, however its files were written, cut or
timed. A number that no row bears is an empty batch.

``Arrivals`` is the other end: the rows of all batches written once, each batch's files then
put into a source folder as they "arrive".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.sources import fs
from netsentry.sources.files import MESSAGES_PER_FILE


class NumberedBatches:
    """``foreachBatch`` handler that calls ``handler(rows, number)`` for each closed batch number.

    The rows of trigger ``id`` are written to ``<path>/rows/trigger=<id>/<batch>=<number>/`` (a replay writes them
    again), a closed number to ``<path>/closed/<number>`` with the trigger that closed it. A row whose number
    was closed by an earlier trigger is late and fails the query; numbers begin at ``first``. The rows of a closed batch are deleted
    unless ``keep`` is set.
    """

    def __init__(self, handler: Callable[[DataFrame, int], None], path: str, batch_col: str = "batch", first: int = 0, keep: bool = False):
        self.handler, self.path, self.batch_col, self.first, self.keep = handler, path.rstrip("/"), batch_col, first, keep
        self.schema = None

    def _closed(self, spark: SparkSession) -> dict[int, int]:
        folder = f"{self.path}/closed"
        return {int(n): int(fs.read_text(spark, f"{folder}/{n}")) for n in fs.list_files(spark, folder) if n.isdigit()}

    def _folders(self, spark: SparkSession) -> dict[int, list[str]]:
        """The folders with rows of each batch number, of triggers whose rows are all there."""
        out: dict[int, list[str]] = {}
        for trigger in fs.list_dirs(spark, f"{self.path}/rows"):
            at = f"{self.path}/rows/{trigger}"
            if fs.committed(spark, at):
                for name in fs.list_dirs(spark, at):
                    out.setdefault(int(name.partition("=")[2]), []).append(f"{at}/{name}")
        return out

    def __call__(self, rows: DataFrame, trigger: int) -> None:
        spark = rows.sparkSession
        self.schema = rows.drop(self.batch_col).schema
        rows.withColumn(self.batch_col, F.col(self.batch_col).cast("long")).write.mode("overwrite") \
            .partitionBy(self.batch_col).parquet(f"{self.path}/rows/trigger={int(trigger)}")
        folders, closed = self._folders(spark), self._closed(spark)
        mine = f"/trigger={int(trigger)}/"
        for number in sorted(folders):
            if closed.get(number, trigger) < trigger and any(mine in f for f in folders[number]):
                raise ValueError(f"late rows: batch {number} was closed before")
        self._close(spark, folders, closed, max(folders, default=self.first), trigger)

    def _close(self, spark: SparkSession, folders: dict[int, list[str]], closed: dict[int, int], until: int, trigger: int) -> None:
        for number in range(max(closed, default=self.first - 1) + 1, until):
            found = folders.get(number, [])
            rows = spark.read.schema(self.schema).parquet(*found) if found else spark.createDataFrame([], self.schema)
            self.handler(rows.withColumn(self.batch_col, F.lit(number).cast("long")), number)
            fs.write_text(spark, f"{self.path}/closed/{number}", str(int(trigger)))
            if not self.keep:
                for f in found:
                    fs.delete(spark, f)

    def finish(self, spark: SparkSession, until: int | None = None) -> None:
        """No more rows will come: close what is open (with ``until``, also empty batches below it)."""
        folders, closed = self._folders(spark), self._closed(spark)
        last = max([*folders, -1]) + 1 if until is None else until
        if folders and self.schema is None:
            some = next(iter(folders.values()))[0]
            self.schema = spark.read.parquet(some).schema
        if last and self.schema is not None:
            self._close(spark, folders, closed, last, 1 << 62)


class Arrivals:
    """Rows written once, in the partitions they have, under their batch numbers; ``deliver`` moves a batch's files into the
    source folder (a move of one folder, no copy). Parquet rows keep their number; of text only the column ``value`` is written."""

    def __init__(self, df: DataFrame, batch_col: str, path: str, fmt: str = "parquet"):
        self.spark, self.path = df.sparkSession, path.rstrip("/")
        self.source = f"{self.path}/source"
        rows = df.withColumn("_of", F.col(batch_col))
        (rows.select("value", "_of") if fmt == "text" else rows).write.option("maxRecordsPerFile", MESSAGES_PER_FILE).partitionBy("_of").format(fmt).save(f"{self.path}/waiting")
        fs.mkdirs(self.spark, self.source)
        self.schema = df.schema

    def numbers(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in fs.list_dirs(self.spark, f"{self.path}/waiting") if n.startswith("_of="))

    def deliver(self, number: int) -> None:
        fs.rename(self.spark, f"{self.path}/waiting/_of={number}", f"{self.source}/arrival-{number}")
