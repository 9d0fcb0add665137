"""Numbered batches, arrivals, published lines and predict-only queries."""

import pytest
from pyspark.sql import functions as F

from netsentry.plans import stream_queries as Q
from netsentry.sources import files, fs, kafka
from netsentry.streaming import scorer, text
from netsentry.streaming.batches import Arrivals, NumberedBatches
from netsentry.streaming.kmeans import KMeansState, StateTable, StreamingKMeans
from netsentry.streaming.linreg import StreamingLinearRegression, WeightTable
from netsentry.streaming.predict import KMeansPredictor, LinearPredictor
from netsentry.streaming.summary import SummarySink, read_summaries
from conftest import SF0001

ROWS = "batch long, x long"


class Seen:
    def __init__(self):
        self.calls = []

    def __call__(self, rows, number):
        assert rows.columns == ["x", "batch"]
        self.calls.append((number, sorted(r.x for r in rows.collect())))


def test_batches_are_whole_whatever_a_trigger_admits(spark, scratch):
    df = spark.range(60).select(F.expr("case when id < 20 then 0 when id < 45 then 2 else 3 end").cast("long").alias("batch"), F.col("id").alias("x"))
    arrivals = Arrivals(df.repartition(7), "batch", f"{scratch}/a")
    assert arrivals.numbers() == [0, 2, 3]
    seen = Seen()
    whole = NumberedBatches(seen, f"{scratch}/numbered")
    triggers = []

    def handler(rows, trigger):
        triggers.append(trigger)
        whole(rows, trigger)

    # one byte: every file is a trigger of its own
    stream = kafka.read_stream(spark, kafka.file_source(arrivals.source, schema=ROWS, max_bytes_per_trigger=1, nested=True))
    q = scorer.start(stream, handler, f"{scratch}/ck", {"processingTime": "0 seconds"})
    try:
        for number in arrivals.numbers():
            arrivals.deliver(number)
            q.processAllAvailable()
    finally:
        q.stop()
    assert len(triggers) > 10
    assert seen.calls == [(0, list(range(20))), (1, []), (2, list(range(20, 45)))]  # 1 is empty, 3 is open
    whole.finish(spark, 5)
    assert seen.calls[3:] == [(3, list(range(45, 60))), (4, [])]


def test_late_rows_fail_and_replays_do_not(spark, scratch):
    def rows(*pairs):
        return spark.createDataFrame(pairs, ROWS)

    seen = Seen()
    whole = NumberedBatches(seen, scratch)
    whole(rows((0, 1), (0, 2)), 0)
    whole(rows((0, 3), (1, 4)), 1)
    whole(rows((0, 3), (1, 4)), 1)  # the trigger again, after its batch was closed
    assert seen.calls == [(0, [1, 2, 3])]
    whole(spark.createDataFrame([], ROWS), 2)
    with pytest.raises(ValueError, match="late rows: batch 0"):
        whole(rows((0, 5)), 3)
    again = NumberedBatches(seen, scratch)  # a restarted driver
    again.finish(spark)
    assert seen.calls[1:] == [(1, [4])]


@pytest.mark.parametrize("name", ["stream_kmeans_stream", "stream_lines", "weight_lines"])
def test_results_do_not_depend_on_the_trigger_cap(spark, name):
    query = Q.STREAM_QUERIES[name]
    assert sorted(map(str, query(spark, SF0001, 1).collect())) == sorted(map(str, query(spark, SF0001).collect()))


def test_caps_exclude_each_other():
    with pytest.raises(ValueError):
        kafka.file_source("x", max_files_per_trigger=1, max_bytes_per_trigger=1)


def test_published_lines(spark, scratch):
    sink = SummarySink(scratch)
    for batch, line in ((0, "1.0,2.0"), (10, "3.0"), (0, "1.5,2.0")):  # 0 is replayed
        sink.publish(spark, batch, line)
    assert sorted(map(tuple, read_summaries(spark, scratch).collect())) == [(0, "1.5,2.0"), (10, "3.0")]
    with pytest.raises(ValueError):
        sink.publish(spark, 1, "a\nb")


def test_predictor_takes_a_version_that_arrives_between_triggers(spark, scratch):
    lines = spark.createDataFrame([(0, "[0.0]"), (0, "[1.0]"), (1, "[9.0]"), (2, "[6.0]")], "batch long, value string")
    arrivals = Arrivals(lines, "batch", f"{scratch}/lines", "text")
    table = StateTable(spark, f"{scratch}/state")
    initial = KMeansState.of([[0.0], [100.0]], [1.0, 1.0])
    predictor = KMeansPredictor(table.path, f"{scratch}/out", initial=initial, keep=["features"])
    stream = text.vectors(files.stream_text(spark, arrivals.source, nested=True))
    q = scorer.start(stream, predictor, f"{scratch}/ck", {"processingTime": "0 seconds"})
    try:
        arrivals.deliver(0)
        q.processAllAvailable()
        table.write(0, KMeansState.of([[0.0], [10.0]], [1.0, 1.0]))
        fs.mkdirs(spark, f"{table.path}/v=1")  # half-written: not seen
        arrivals.deliver(1)
        q.processAllAvailable()
        table.write(1, KMeansState.of([[9.0], [6.0]], [1.0, 1.0]))
        arrivals.deliver(2)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["features"][0], r["cluster"], r["version"]) for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [(0.0, 0, None), (1.0, 0, None), (6.0, 1, 1), (9.0, 1, 0)]
    # a trigger that is replayed keeps the predictions of then
    predictor(spark.createDataFrame([([6.0],)], "features array<double>"), 0)
    assert spark.read.parquet(f"{scratch}/out/batch=0").count() == 2


def test_linear_predictor(spark, scratch):
    rows = spark.createDataFrame([(1.0, [1.0, 2.0])], "label double, features array<double>")
    predictor = LinearPredictor(f"{scratch}/w", f"{scratch}/out", keep=["label"])
    with pytest.raises(RuntimeError, match="no committed model"):
        predictor(rows, 0)
    import numpy as np
    WeightTable(spark, f"{scratch}/w").write(4, np.array([10.0, 0.5]))
    predictor(rows, 0)
    assert [tuple(r) for r in spark.read.parquet(f"{scratch}/out/batch=0").collect()] == [(1.0, 11.0, 4)]


def test_models_of_another_query_are_not_replays(spark, scratch):
    rows = spark.createDataFrame([([1.0],), ([2.0],)], "features array<double>")
    rows.write.parquet(f"{scratch}/source")
    model = StreamingKMeans(1, state_path=f"{scratch}/state", centers=[[0.0]], weights=[0.0])
    stream = kafka.read_stream(spark, kafka.file_source(f"{scratch}/source", schema="features array<double>"))
    for checkpoint, fails in (("ck1", False), ("ck2", True)):
        q = scorer.start(stream, model.foreach_batch, f"{scratch}/{checkpoint}", {"availableNow": True})
        try:
            q.awaitTermination()
            failed = False
        except Exception as e:
            assert "folder of its own" in str(e)
            failed = True
        assert failed == fails
    line = StreamingLinearRegression([0.0], state_path=f"{scratch}/w", label="y")
    WeightTable(spark, f"{scratch}/w").write(0, line.w0, "another")
    with pytest.raises(ValueError, match="folder of its own"):
        WeightTable(spark, f"{scratch}/w").read(0, "this one")


def test_text_parsers_mark_bad_lines(spark):
    lines = ["[1.0,2.0]", "(3,[1],[5.0])", "[1.0,x]", "(3,[7],[1.0])", "", None]
    got = text.tagged_vectors(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["features"], r["reason"]) for r in got] == [([1.0, 2.0], None), ([0.0, 5.0, 0.0], None)] + [(None, "bad_vector")] * 4
    lines = ["(1.0,[2.0])", "(1.0), [1.7, 0.4]", "3,1 2", "(x,[1.0])", "(1,[y])", "3,1 z", "nothing", None]
    got = text.tagged_points(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["label"], r["features"]) for r in got][:3] == [(1.0, [2.0]), (1.0, [1.7, 0.4]), (3.0, [1.0, 2.0])]
    assert [r["reason"] for r in got][3:] == ["bad_label", "bad_vector", "bad_vector", "bad_label", "bad_label"]
    with pytest.raises(Exception, match="not a labelled point"):
        text.labeled_points(spark.createDataFrame([("(x,[1.0])",)], "value string")).collect()


def test_scorer_writes_a_batch_without_records(spark, scratch):
    from netsentry.functions import records as R
    from netsentry.plans import pipelines
    train = Q._event_records(spark, SF0001)
    m1, m2, _ = pipelines.fit_two_stage(train, R.SYMBOLIC_INPUTS, R.ASSEMBLER_INPUTS, 2, "timeStamp")
    scorer.Scorer(m1, m2, scratch)(spark.createDataFrame([("no record",), (None,)], "value string"), 0)
    assert spark.read.parquet(f"{scratch}/scored/batch=0").columns == ["timeStamp", "srcIp", "desIp", R.PREDICTED_LABEL]
    assert spark.read.parquet(f"{scratch}/rejects/batch=0").count() == 1
    given = []
    scorer.Scorer(m1, m2, scratch, sink=lambda df, i: given.append(i))(spark.createDataFrame([("no record",)], "value string"), 1)
    assert given == []
