"""File sources and sinks.

Batch reads take an explicit schema (no inference pass over the data);
streaming reads take the same schema plus a per-trigger file cap, the file
source's form of a rate limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.sources import kafka

#: Rows of a message file: a few MB at most, far below what a trigger admits. One file of one row group is read by one task
#: whatever its size, so a micro-batch of few large files would keep all other cores waiting.
MESSAGES_PER_FILE = 20_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE",
             sep: str = ",", header: bool = False, corrupt: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV files with an explicit schema (no pass over the data to infer one).

    PERMISSIVE turns a bad number into null (the assembler then rejects the row) and, if ``corrupt`` names a
    column, keeps the line that could not be read whole in it (null for good lines); DROPMALFORMED leaves
    such lines out; FAILFAST fails. A line with too few or too many fields is one of them. ``header`` skips the first line of
    each file. Files are split into tasks unless ``multi_line`` allows line ends inside quotes.
    """
    own = schema.fieldNames()
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    reader = spark.read.schema(schema).option("mode", mode).option("sep", sep).option("header", header).option("multiLine", multi_line)
    # What makes a line bad must not depend on which columns the caller goes on to use: a condition that always holds,
    # but names every column, keeps them from being pruned.
    always = F.pmod(F.hash(*own), F.lit(1)) == 0
    if corrupt:
        rows = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False).csv(path)
        return rows.withColumn(corrupt, F.when(always, F.col(corrupt)))
    return reader.csv(path) if mode.upper() == "PERMISSIVE" else reader.option("columnPruning", False).csv(path).where(always)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    """CSV files, one for each of ``df``'s partitions."""
    df.write.option("sep", sep).option("header", header).csv(path)


def parse_csv_lines(df: DataFrame, col: str, schema: T.StructType, keep: list[str] | None = None,
                    mode: str = "PERMISSIVE") -> DataFrame:
    """S1 over lines already in a DataFrame (e.g. a message value): the same
    CSV parser, as a column expression."""
    parsed = F.from_csv(F.col(col), schema.simpleString()[len("struct<"):-1].replace(":", " "), {"mode": mode})
    return df.select(*(keep or []), parsed.alias("_ns_r")).select(*(keep or []), "_ns_r.*")


def read_text(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """One row per line, column ``value``. Lines end at ``\\n``, ``\\r`` or both unless ``line_sep`` names their
    end. Files are split into tasks at line ends."""
    r = spark.read
    return (r.option("lineSep", line_sep) if line_sep else r).text(path)


def write_text(df: DataFrame, path: str, col: str = "value", line_sep: str = "\n") -> None:
    """Text files, a line for each row, one file for each of ``df``'s partitions."""
    df.select(col).write.option("lineSep", line_sep).text(path)


def stream_text(spark: SparkSession, path: str, max_bytes_per_trigger: int | None = None, line_sep: str | None = None,
                nested: bool = False) -> DataFrame:
    """The lines of every new file in a directory, column ``value``; S6: so many bytes of files a trigger."""
    spec = kafka.file_source(path, "text", max_bytes_per_trigger=max_bytes_per_trigger, nested=nested)
    if line_sep:
        spec.options["lineSep"] = line_sep
    return kafka.read_stream(spark, spec)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict) -> None:
    """Scored rows to a JDBC table (needs the driver jar on the class path)."""
    df.write.jdbc(url, table, mode="append", properties=properties)
