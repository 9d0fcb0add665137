from conftest import SF0001


def test_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["key", "cluster"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name in ["nearest_center", "parse_lenient", "pipeline_features", "stream_kmeans_fold", "accuracy"]:
        assert q[name](spark, SF0001).count() >= 0


def test_streaming_queries_run(spark):
    import __spark_entry__ as E
    q = E.queries()
    lines = q["stream_lines"](spark, SF0001)
    parsed = q["parse_lenient"](spark, SF0001)
    assert lines.count() == parsed.count() > 0
    assert q["stream_union"](spark, SF0001).count() == parsed.count()
    scored = q["score_stream"](spark, SF0001)
    assert scored.count() == parsed.count()
    assert set(r[0] for r in scored.select("predictedLabel").distinct().collect()) <= {"smurf.", "neptune.", "normal."}
    hop = q["two_hop_stream"](spark, SF0001)
    assert hop.count() == spark.read.parquet(f"{SF0001}/events.parquet").count()
    assert {r[0] for r in hop.select("cluster").distinct().collect()} <= set(range(30))


def test_streamed_models_equal_folds(spark):
    """A real file stream, one logical batch per trigger, gives the fold's
    results exactly."""
    import __spark_entry__ as E
    q = E.queries()
    streamed = sorted(tuple(r) for r in q["stream_kmeans_stream"](spark, SF0001).collect())
    folded = sorted(tuple(r) for r in q["stream_kmeans_assign"](spark, SF0001).collect())
    assert streamed == folded and len(streamed) > 0
    w_stream = sorted(tuple(r) for r in q["stream_linreg_stream"](spark, SF0001).collect())
    w_fold = sorted(tuple(r) for r in q["stream_linreg_fold"](spark, SF0001).collect())
    assert w_stream == w_fold
