"""CSV and text files, with bad lines."""

import pytest
from pyspark.sql import functions as F

from netsentry.sources import files, models

SCHEMA_TEXT = "a long, b double, c string"


def schema():
    from pyspark.sql import types as T
    return T._parse_datatype_string(SCHEMA_TEXT)


def write(spark, path, lines):
    files.write_text(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), path)
    return path


LINES = ["1,2.5,x", "2,oops,y", "3,1.0", "4,1.0,z,extra", '5,1.0,"q,r"']


def test_permissive_keeps_what_can_be_read(spark, scratch):
    path = write(spark, scratch, LINES)
    got = files.read_csv(spark, path, schema()).collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "x"), (2, None, "y"), (3, 1.0, None), (4, 1.0, "z"), (5, 1.0, "q,r")]


def test_corrupt_lines_whichever_columns_are_used(spark, scratch):
    path = write(spark, scratch, LINES)
    rows = files.read_csv(spark, path, schema(), corrupt="bad")
    assert [r["bad"] for r in rows.collect()] == [None, *LINES[1:4], None]
    assert [r["bad"] for r in rows.select("bad").collect()] == [None, *LINES[1:4], None]
    assert rows.where(F.col("bad").isNotNull()).count() == 3
    assert [r["a"] for r in files.read_csv(spark, path, schema(), mode="DROPMALFORMED").select("a").collect()] == [1, 5]
    with pytest.raises(Exception):
        files.read_csv(spark, path, schema(), mode="FAILFAST").select("a").collect()


def test_header_separator_and_quoted_line_ends(spark, scratch):
    df = spark.createDataFrame([(1, 2.0, "x\ny"), (2, None, "z")], SCHEMA_TEXT)
    files.write_csv(df.coalesce(1), scratch, sep=";", header=True)
    got = files.read_csv(spark, scratch, schema(), sep=";", header=True, multi_line=True).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 2.0, "x\ny"), (2, None, "z")]


def test_a_large_file_is_split(spark, scratch):
    files.write_text(spark.range(200_000).select(F.concat_ws(",", "id", F.lit("1.5"), F.lit("text")).alias("value")).coalesce(1), scratch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        assert files.read_csv(spark, scratch, schema()).select(F.spark_partition_id()).distinct().count() > 2
        assert files.read_text(spark, scratch).select(F.spark_partition_id()).distinct().count() > 2
        assert files.read_csv(spark, scratch, schema()).agg(F.sum("a"), F.count("*")).first()[:] == (200_000 * 199_999 // 2, 200_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_separator(spark, scratch):
    files.write_text(spark.createDataFrame([("a\rb",), ("",), ("c",)], "value string").coalesce(1), scratch)
    assert [r[0] for r in files.read_text(spark, scratch, "\n").collect()] == ["a\rb", "", "c"]


def test_half_written_model_is_not_loaded(spark, scratch):
    with pytest.raises(FileNotFoundError):
        models.load_pipeline(scratch)
