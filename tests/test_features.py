import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from netsentry.functions import vectors as V
from netsentry.operators import features
from netsentry.sources.spec import schema_from_spec, symbolic_columns
from netsentry.functions.records import KDD_SPEC_TEXT


def test_indexer_order_and_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "s string")
    m = features.string_indexer(["s"]).fit(df)
    assert list(m.labelsArray[0]) == ["b", "a", "c"]
    idx = m.transform(df)
    enc = features.one_hot_encoder(["s_index"]).fit(idx).transform(idx)
    got = {r["s"]: r["v"] for r in enc.select("s", vector_to_array("s_Vec").alias("v")).collect()}
    assert got == {"b": [1.0, 0.0], "a": [0.0, 1.0], "c": [0.0, 0.0]}


def test_unseen_category(spark):
    train = spark.createDataFrame([("a",), ("b",)], "s string")
    test = spark.createDataFrame([("a",), ("z",)], "s string")
    with pytest.raises(Exception):
        features.string_indexer(["s"]).fit(train).transform(test).collect()
    keep = features.string_indexer(["s"], handle_invalid="keep").fit(train).transform(test)
    assert sorted(r[0] for r in keep.select("s_index").collect()) == [0.0, 2.0]
    skip = features.string_indexer(["s"], handle_invalid="skip").fit(train).transform(test)
    assert skip.count() == 1


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "a array<double>") \
        .select(V.to_vector("a").alias("features"))
    out = features.std_scaler().fit(df).transform(df).select(vector_to_array("scaledFeatures")).collect()
    got = [[round(x, 4) for x in r[0]] for r in out]
    assert got == [[0.7071, 0.0], [2.1213, 0.0]]


def test_assembler_rejects_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        features.assembler(["a", "b"]).transform(df).collect()


def test_hash_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a, b = features.hash_split(df, "k", [0.7, 0.3])
    a2, _ = features.hash_split(df.repartition(7), "k", [0.7, 0.3])
    ka = sorted(r[0] for r in a.collect())
    assert ka == sorted(r[0] for r in a2.collect())
    assert a.count() + b.count() == 2000 and 0.6 < len(ka) / 2000 < 0.8


def test_symbolic_cardinality_counts_null(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x"), (None, "y")], "p string, q string")
    for approx in (False, True):
        got = {r["column"]: r["n"] for r in features.symbolic_cardinality(df, ["p", "q"], approx).collect()}
        assert got == {"p": 3, "q": 3}


def test_spec_schema():
    st = schema_from_spec(KDD_SPEC_TEXT)
    assert len(st.fields) == 42 and st.fields[-1].name == "label"
    assert st["duration"].dataType.simpleString() == "double"
    assert schema_from_spec(KDD_SPEC_TEXT, "float")["src_bytes"].dataType.simpleString() == "float"
    assert symbolic_columns(KDD_SPEC_TEXT) == ["protocol_type", "service", "flag", "land", "logged_in",
                                                "is_host_login", "is_guest_login"]
    with pytest.raises(ValueError):
        schema_from_spec("classes.\nx: weird.\n")


def test_csv_scan_permissive(spark, scratch):
    from netsentry.sources import files
    path = scratch + "/csv"
    spark.createDataFrame([("tcp,1.5",), ("udp,abc",)], "value string").write.text(path)
    st = schema_from_spec("c.\nproto: symbolic.\nbytes: continuous.\n", label=None)
    rows = sorted(files.read_csv(spark, path, st).collect(), key=lambda r: r[0])
    assert [(r[0], r[1]) for r in rows] == [("tcp", 1.5), ("udp", None)]


def test_stream_specs():
    from netsentry.sources import kafka
    src = kafka.kafka_source("broker:9092", "records", max_offsets_per_trigger=kafka.rate_cap(1000, 4, 5),
                             group_id="g1")
    assert src.format == "kafka" and src.options["subscribe"] == "records"
    assert src.options["startingOffsets"] == "earliest"
    assert src.options["maxOffsetsPerTrigger"] == "20000"
    assert src.options["kafka.max.partition.fetch.bytes"] == str(50 * 1024 * 1024)
    assert kafka.kafka_sink_options("b:1", "mid") == {"kafka.bootstrap.servers": "b:1", "topic": "mid"}
    f = kafka.file_source("/x", max_files_per_trigger=3)
    assert f.options == {"maxFilesPerTrigger": "3"} and f.schema == "value string"


def test_half_written_model_is_refitted(spark, scratch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    from netsentry.sources import models
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, v double")
    pipeline = Pipeline(stages=[StringIndexer(inputCol="s", outputCol="i")])
    path = f"{scratch}/model"
    spark.createDataFrame([("half",)], "value string").write.text(f"{path}/metadata")
    models.load_or_fit(spark, path, pipeline, df)
    again = models.load_or_fit(spark, path, None, df)  # loaded: nothing to fit
    assert [r.i for r in again.transform(df).orderBy("s").collect()] == [0.0, 1.0]
