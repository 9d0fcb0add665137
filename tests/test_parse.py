import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from netsentry.functions import parse as P
from netsentry.functions import records as R

GOOD = "t1,1.2.3.4,5.6.7.8,0.5,tcp,http,SF,100,200,0," + ",".join(str(i) for i in range(21))


def _lines(spark, *lines):
    return spark.createDataFrame([(l,) for l in lines], "line string")


def test_jvm_split_rules(spark):
    df = spark.createDataFrame([("a,b,,",), ("",), (",,",), ("a,,b",)], "s string")
    got = [r[0] for r in df.select(P.jvm_split("s", ",")).collect()]
    assert got == [["a", "b"], [""], [], ["a", "", "b"]]


def test_explode_two_records_and_empty_message(spark):
    df = spark.createDataFrame([(1, GOOD + "\n" + GOOD), (2, ""), (3, GOOD + "\n")], "id int, value string")
    rows = P.explode_records(df).select("id", "line_no").collect()
    assert sorted((r[0], r[1]) for r in rows) == [(1, 0), (1, 1), (2, 0), (3, 0)]


def test_strict_parse_good_and_extra_fields(spark):
    good, _ = P.parse_records(_lines(spark, GOOD, GOOD + ",extra,9"), R.stream_record_schema(), "line", "strict")
    rows = good.collect()
    assert len(rows) == 2 and rows[0]["duration"] == 0.5 and rows[1]["dst_host_srv_rerror_rate"] == 20.0
    assert rows[0]["count"] == 2.0


@pytest.mark.parametrize("bad", [
    ",".join(GOOD.split(",")[:20]),                 # short row
    GOOD.replace(",0.5,", ",,", 1),                 # empty number
    GOOD.replace(",0.5,", ",abc,", 1),              # text in a number
])
def test_strict_parse_fails_job(spark, bad):
    good, _ = P.parse_records(_lines(spark, bad), R.stream_record_schema(), "line", "strict")
    with pytest.raises(Exception):
        good.collect()


def test_lenient_parse_splits_rejects(spark):
    lines = _lines(spark, GOOD, ",".join(GOOD.split(",")[:20]), GOOD.replace(",0.5,", ",abc,", 1), "",
                   GOOD.replace(",0.5,", ", 1.5 ,", 1), GOOD.replace(",0.5,", ",1d,", 1))
    good, rejects = P.parse_records(lines, R.stream_record_schema(), "line", "lenient")
    assert sorted(r["duration"] for r in good.collect()) == [0.5, 1.0, 1.5]  # JVM rules: blanks and 1d accepted
    assert sorted(r["reason"] for r in rejects.collect()) == ["bad_number", "short", "short"]


def test_parse_vector_dense_sparse(spark):
    df = spark.createDataFrame([("[1.0,2.5,-3.0]",), ("(4,[0,3],[7.0,1.5])",), ("(3,[],[])",), ("[]",),
                                ("(0,[],[])",), ("junk",)], "t string")
    got = [r[0] for r in df.select(P.parse_vector("t", "lenient")).collect()]
    assert got == [[1.0, 2.5, -3.0], [7.0, 0.0, 0.0, 1.5], [0.0, 0.0, 0.0], [], [], None]


def test_vector_text_roundtrip(spark):
    df = spark.createDataFrame([([0.0, 1e-05, 3.25, 0.0],)], "a array<double>")
    row = df.select(P.parse_vector(P.vector_text("a")).alias("d"),
                    P.parse_vector(P.vector_text("a", sparse=True)).alias("s"),
                    P.vector_text("a", sparse=True).alias("st")).first()
    assert row["d"] == [0.0, 1e-05, 3.25, 0.0] and row["s"] == [0.0, 1e-05, 3.25, 0.0]
    assert row["st"].startswith("(4,[1,2],[")


def test_labeled_point_forms(spark):
    df = spark.createDataFrame([("(1.0,[1.7,0.4,0.9])",), ("(2.0,(3,[1],[5.0]))",), ("3.0,1 2 3",),
                                ("(1.0), [1.7, 0.4, 0.9]",)], "t string")
    got = [(r["lp"]["label"], r["lp"]["features"]) for r in df.select(P.parse_labeled_point("t").alias("lp")).collect()]
    assert got == [(1.0, [1.7, 0.4, 0.9]), (2.0, [0.0, 5.0, 0.0]), (3.0, [1.0, 2.0, 3.0]), (1.0, [1.7, 0.4, 0.9])]


def test_dense_space_vector_and_bad_number(spark):
    df = spark.createDataFrame([("0.0 0.1 0.2",)], "t string")
    assert df.select(P.parse_dense_vector("t")).first()[0] == [0.0, 0.1, 0.2]
    bad = spark.createDataFrame([("0.0 x",)], "t string")
    with pytest.raises(Exception):
        bad.select(P.parse_dense_vector("t")).collect()


def test_split_key_vector_and_format(spark):
    df = spark.createDataFrame([("t1 10.0.0.1 10.0.0.2 [1.0,2.0]",), ("[3.0]",)], "m string")
    rows = df.select(*P.split_key_vector("m")).collect()
    assert rows[0]["key"] == "t1 10.0.0.1 10.0.0.2" and rows[0]["vector_text"] == "[1.0,2.0]"
    assert rows[1]["key"] is None
    out = spark.createDataFrame([("a", "b", [1.0, 2.0])], "x string, y string, v array<double>") \
        .select(P.format_vector_message(["x", "y"], F.col("v"))).first()[0]
    assert out == "a b [1.0,2.0]"


def test_tokenize(spark):
    df = spark.createDataFrame([("1 2  3 ",)], "t string")
    assert df.select(P.tokenize("t")).first()[0] == ["1", "2", "", "3"]


def test_lenient_rejects_null_line(spark):
    lines = spark.createDataFrame([(GOOD,), (None,)], "line string")
    good, rejects = P.parse_records(lines, R.stream_record_schema(), "line", "lenient")
    assert good.count() == 1 and [r["reason"] for r in rejects.collect()] == ["short"]


def test_vector_text_auto_form(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 2.0],), ([1.0, 2.0, 0.0],)], "a array<double>")
    rows = df.select(P.vector_text("a", "auto").alias("t"), P.parse_vector(P.vector_text("a", "auto")).alias("b"),
                     "a").collect()
    assert rows[0]["t"] == "(5,[4],[2.0])" and rows[1]["t"] == "[1.0,2.0,0.0]"
    assert all(r["b"] == r["a"] for r in rows)


@pytest.mark.parametrize("text", ["junk", "[1.0,null]", "[1.0,x]", "(3,[5],[1.0])", "(3,[-1],[1.0])", "(3,[0,1],[1.0])"])
def test_bad_vectors_fail_or_are_null(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(P.parse_vector("t", "lenient")).collect()] == [None, None]
    assert df.where("t is null").select(P.parse_vector("t")).first()[0] is None
    with pytest.raises(Exception, match="not a vector"):
        df.select(P.parse_vector("t")).collect()


def test_bad_label_fails(spark):
    with pytest.raises(Exception, match="not a labelled point"):
        spark.createDataFrame([("(x,[1.0])",)], "t string").select(P.parse_labeled_point("t")).collect()


def test_strict_fails_under_any_projection(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.DoubleType())])
    for bad in ("x,y,1.0", "x,1.5,1.0", "x,1", None):
        rows, _ = P.parse_records(_lines(spark, "x,1,2.0", bad), schema, "line", "strict")
        for use in (lambda: rows.count(), lambda: rows.select("a").collect()):
            with pytest.raises(Exception, match="cannot read the record"):
                use()
        good, rejects = P.parse_records(_lines(spark, "x,1,2.0", bad), schema, "line", "lenient")
        assert good.collect() == [("x", 1, 2.0)] and [r.line for r in rejects.collect()] == [bad]
