"""Registered queries that run real Structured Streaming jobs.

Each one writes its input (derived from a test table by Spark, in the scan's own partitions) as
files into a fresh folder under the shared ``spark.checkpoint.dir``, streams
them, a number of bytes a trigger, and returns what the sinks hold as a DataFrame.
Where the result depends on what a micro-batch is, batches are numbered by their rows, or
arrive one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsentry.functions import parse as P
from netsentry.functions import records as R
from netsentry.plans import pipelines
from netsentry.plans import standins as S
from netsentry.session import scratch_path
from netsentry.sources import files, kafka
from netsentry.streaming import scorer, text, topology
from netsentry.streaming.batches import Arrivals, NumberedBatches
from netsentry.streaming.kmeans import StateTable, StreamingKMeans, predict_versions
from netsentry.streaming.linreg import StreamingLinearRegression
from netsentry.streaming.predict import KMeansPredictor, LinearPredictor
from netsentry.streaming.summary import SummarySink, read_summaries

#: Bytes of files that a trigger admits.
TRIGGER_BYTES = 64 << 20


def _write_messages(df: DataFrame, path: str) -> None:
    """Message files of a source folder (the stand-in of a topic), each small beside what a trigger admits: the tasks of a
    micro-batch share it by its files."""
    df.select("value").write.option("maxRecordsPerFile", files.MESSAGES_PER_FILE).parquet(path)


def _message_stream(spark: SparkSession, path: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    return kafka.read_stream(spark, kafka.file_source(path, max_bytes_per_trigger=trigger_bytes))


def _ended(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _drain(stream: DataFrame, handler: Callable, checkpoint: str) -> None:
    _ended(scorer.start(stream, handler, checkpoint, {"availableNow": True}))


#: Events a task makes lines of and parses: far more work than their few bytes in the table show.
EVENTS_PER_TASK = 50_000


def _spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, in as many partitions as their number (the table's own count) asks for: a large table of few row groups is else read,
    and all that follows done, by as few tasks. A small table stays as it is."""
    ev = S.events(spark, sf_dir)
    tasks = ev.count() // EVENTS_PER_TASK
    return ev.repartition(tasks) if tasks > 1 else ev


def _event_lines(spark, sf_dir, line):
    """``event_id`` and the line, made once however often it is used: an alias would be put in place of every mention, a generated
    column is not."""
    return _spread_events(spark, sf_dir).select("event_id", F.explode(F.array(line)).alias("line"))


def _event_messages(spark, sf_dir, corrupted=True):
    lines = _event_lines(spark, sf_dir, S.event_line_corrupted() if corrupted else S.event_line())
    return lines.select(S.event_message(F.col("line")).alias("value"))


def _event_record_lines(spark, sf_dir):
    """One well-formed record per message (the strict hop-1 input)."""
    return S.events(spark, sf_dir).select(S.event_line().alias("value"))


class _ParseSink:
    def __init__(self, out):
        self.out = out

    def __call__(self, batch, batch_id):
        good, rejects = scorer.parse_messages(batch, "lenient")
        good.write.mode("overwrite").parquet(f"{self.out}/batch={int(batch_id)}")


def q_stream_lines(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """S6 + S8 + T1 + P1 + P3: message files streamed with a cap of bytes per
    trigger; each micro-batch is exploded and leniently parsed."""
    base = scratch_path(spark, "stream-lines")
    _write_messages(_event_messages(spark, sf_dir), f"{base}/source")
    _drain(_message_stream(spark, f"{base}/source", trigger_bytes), _ParseSink(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").drop("batch")


def q_stream_union(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """X1 + S7: two sources (two receivers/topics) unioned into one stream."""
    base = scratch_path(spark, "stream-union")
    msgs = _event_messages(spark, sf_dir).withColumn("_src", F.pmod(F.xxhash64("value"), F.lit(2)))
    msgs.write.option("maxRecordsPerFile", files.MESSAGES_PER_FILE).partitionBy("_src").parquet(f"{base}/sources")
    streams = [_message_stream(spark, f"{base}/sources/_src={d}", trigger_bytes) for d in range(2)]
    _drain(kafka.union_streams(streams), _ParseSink(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").drop("batch")


def _event_records(spark, sf_dir):
    lines = _event_lines(spark, sf_dir, S.event_line())
    rec, _ = P.parse_records(lines, R.stream_record_schema(), "line", "strict")
    # a learnable class rule over the record's own fields
    label = (F.when(F.col("duration") > 100, F.lit("smurf.")).when(F.col("protocol_type") == "error", F.lit("neptune."))
             .otherwise(F.lit("normal.")))
    return rec.withColumn("label", label)


def _scored(spark: SparkSession, sf_dir: str, trigger_bytes: int):
    """Both stages fitted on the parsed records and saved, and the record message stream scored batch by batch with them: (models, base folder)."""
    base = scratch_path(spark, "score-stream")
    train = pipelines.materialize(_event_records(spark, sf_dir), f"{base}/train")
    m1, m2, _ = pipelines.fit_two_stage(train, R.SYMBOLIC_INPUTS, R.ASSEMBLER_INPUTS, 4, "timeStamp",
                                        path1=f"{base}/pipeline1", path2=f"{base}/pipeline2")
    _write_messages(_event_messages(spark, sf_dir), f"{base}/source")
    _drain(_message_stream(spark, f"{base}/source", trigger_bytes), scorer.Scorer(m1, m2, f"{base}/out"), f"{base}/checkpoint")
    return (m1, m2), base


def q_score_stream(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """T4 + F11 + P14: the streamed scores (timeStamp, srcIp, desIp, predictedLabel)."""
    _, base = _scored(spark, sf_dir, trigger_bytes)
    return spark.read.parquet(f"{base}/out/scored").drop("batch")


def q_score_stream_as_batch(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """T4 + F11 row by row: each streamed record, and whether its label is the one that the same saved models give
    the record in one batch (timeStamp, srcIp, desIp, as_in_batch)."""
    (m1, m2), base = _scored(spark, sf_dir, trigger_bytes)
    key = ["timeStamp", "srcIp", "desIp"]
    good, _ = scorer.parse_messages(spark.read.schema("value string").parquet(f"{base}/source"))
    batch = pipelines.score(good, m1, m2, key).withColumnRenamed(R.PREDICTED_LABEL, "_batch")
    streamed = spark.read.parquet(f"{base}/out/scored").drop("batch")
    return streamed.join(batch, key, "full").select(*key, F.col(R.PREDICTED_LABEL).eqNullSafe(F.col("_batch")).alias("as_in_batch"))


def _two_hops(spark: SparkSession, sf_dir: str, trigger_bytes: int) -> str:
    """T2 with two streaming queries: records -> scaled-vector messages on an
    intermediate folder -> online k-means (k = 30, decay 0.95) -> key/cluster; the folder of all that."""
    base = scratch_path(spark, "two-hop")
    train = pipelines.materialize(_event_records(spark, sf_dir), f"{base}/train")
    pre = pipelines.stage1_pipeline(R.SYMBOLIC_INPUTS, R.ASSEMBLER_INPUTS, None, None).fit(train)
    dim = len(train.limit(1).transform(pre.transform).select(R.SCALED_FEATURES).first()[0])
    _write_messages(_event_record_lines(spark, sf_dir), f"{base}/source")
    _ended(topology.start_hop1(_message_stream(spark, f"{base}/source", trigger_bytes), pre, f"{base}/mid", f"{base}/ck1", {"availableNow": True}))
    # the original online job: k = 30, decay 0.95, random centres of weight 1;
    # the width comes from the fitted pre-processing, not a constant
    model = StreamingKMeans(30, 0.95, "batches", state_path=f"{base}/state", out_path=f"{base}/out",
                            vec_col="x", key_cols=["key"], dim=dim, init_weight=1.0, seed=7)
    _drain(_message_stream(spark, f"{base}/mid", trigger_bytes), topology.Hop2(model), f"{base}/ck2")
    return base


def q_two_hop_stream(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """Each message's key and cluster."""
    return spark.read.parquet(f"{_two_hops(spark, sf_dir, trigger_bytes)}/out/assignments").select("key", "cluster")


def q_two_hop_nearest(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """T2 row by row: each message's key, and whether its cluster is the nearest under the model version stored for its
    micro-batch."""
    base = _two_hops(spark, sf_dir, trigger_bytes)
    sent = topology.hop2_vectors(spark.read.schema("value string").parquet(f"{base}/mid"))
    got = spark.read.parquet(f"{base}/out/assignments")
    checked = predict_versions(sent.join(got, "key"), "x", "batch", StateTable(spark, f"{base}/state").read_all(), "_nearest")
    return checked.select("key", (F.col("cluster") == F.col("_nearest")).alias("nearest"))


def _numbered(model, arrivals: Arrivals, base: str, trigger_bytes: int) -> None:
    """Deliver batch after batch to a running query that trains ``model`` on whole numbered batches."""
    spark = arrivals.spark
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrivals.schema)
    stream = kafka.read_stream(spark, kafka.file_source(arrivals.source, schema=schema, max_bytes_per_trigger=trigger_bytes, nested=True))
    whole = NumberedBatches(model.foreach_batch, f"{base}/numbered")
    q = scorer.start(stream, whole, f"{base}/checkpoint", {"processingTime": "0 seconds"})
    try:
        for number in arrivals.numbers():
            arrivals.deliver(number)
            q.processAllAvailable()
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    whole.finish(spark, S.N_BATCHES)


def _event_kmeans(spark: SparkSession, sf_dir: str, name: str, trigger_bytes: int) -> str:
    """M6-M9 + T1 + T3 as a running stream over the numbered batches of ``events.value``; the folder of its outputs."""
    from netsentry.plans.queries import DECAY, INIT_CENTERS, INIT_WEIGHTS
    base = scratch_path(spark, name)
    ev = S.events(spark, sf_dir).select("event_id", S.event_batch().cast("long").alias("batch"), F.array("value").alias("x"))
    model = StreamingKMeans(len(INIT_CENTERS), DECAY, "batches", state_path=f"{base}/state", out_path=f"{base}/out", vec_col="x", key_cols=["event_id"],
                            centers=INIT_CENTERS, weights=INIT_WEIGHTS, summary=SummarySink(f"{base}/weights"))
    _numbered(model, Arrivals(ev, "batch", f"{base}/arrivals"), base, trigger_bytes)
    return base


def q_stream_kmeans_stream(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """Train, publish weights, predict, batch by batch. Equals the batch fold exactly."""
    base = _event_kmeans(spark, sf_dir, "stream-kmeans", trigger_bytes)
    return spark.read.parquet(f"{base}/out/assignments").select("event_id", "cluster")


def q_weight_lines(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """S10 + P11: the weights lines that the running stream published, read back and taken apart."""
    base = _event_kmeans(spark, sf_dir, "weight-lines", trigger_bytes)
    lines = read_summaries(spark, f"{base}/weights")
    return lines.select("batch", F.posexplode(P.parse_dense_vector("value", ",")).alias("cluster", "weight")).select(
        "batch", F.col("cluster").cast("int"), F.round("weight", 6).alias("weight"))


def q_stream_linreg_stream(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """M11 + T1 as a running stream over the numbered batches of lineitem;
    the final weights equal the batch fold exactly."""
    from netsentry.plans.queries import LR_DIM, _lr_data
    base = scratch_path(spark, "stream-linreg")
    data = _lr_data(spark, sf_dir).select(F.col("batch").cast("long").alias("batch"), "x", "y")
    model = StreamingLinearRegression([0.0] * LR_DIM, state_path=f"{base}/state", out_path=f"{base}/out",
                                      features="x", label="y")
    _numbered(model, Arrivals(data, "batch", f"{base}/arrivals"), base, trigger_bytes)
    w = model.weights_before(spark, 1 << 30)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "slot int, weight double") \
        .select("slot", F.round("weight", 9).alias("weight"))


# ----------------------------------------------- training on one stream, predicting on another
#: Arrival of the lines to predict -> the number of training batches that have arrived by then.
PREDICT_AFTER = {0: 1, 1: S.N_BATCHES}


def _train_and_predict(spark: SparkSession, train: DataFrame, test: DataFrame, parse: tuple[Callable, Callable],
                       model, predictor, base: str) -> None:
    """Two running queries on two text directories: one trains a model, the other predicts with the newest version
    it finds. ``train`` and ``test`` are (batch, value) lines; an arrival is a micro-batch."""
    sides = [Arrivals(lines, "batch", f"{base}/{name}", "text") for name, lines in (("train", train), ("test", test))]
    queries = []
    try:
        for k, (side, parser, handler) in enumerate(zip(sides, parse, (model.foreach_batch, predictor))):
            lines = files.stream_text(spark, side.source, line_sep="\n", nested=True)
            queries.append(scorer.start(parser(lines), handler, f"{base}/checkpoint-{k}", {"processingTime": "0 seconds"}))
        trained = 0
        for number in sides[1].numbers():
            while trained < PREDICT_AFTER[number]:
                sides[0].deliver(trained)
                queries[0].processAllAvailable()
                trained += 1
            sides[1].deliver(number)
            queries[1].processAllAvailable()
    finally:
        for q in queries:
            q.stop()


def q_stream_kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + M8 + S8 + P7 + P8: online k-means trained on a directory of vector lines, labelled points of another directory predicted by
    the newest committed model: (event_id, cluster, version). Even ids arrive after one training batch, odd ids after all."""
    from netsentry.plans.queries import DECAY, INIT_CENTERS, INIT_WEIGHTS
    base = scratch_path(spark, "kmeans-predict")
    ev = S.events(spark, sf_dir)
    vec = P.vector_text(F.array("value"))
    train = ev.select(S.event_batch().alias("batch"), vec.alias("value"))
    test = ev.select(F.pmod("event_id", F.lit(2)).alias("batch"), F.concat(F.lit("("), F.col("event_id").cast("string"), F.lit(","), vec, F.lit(")")).alias("value"))
    model = StreamingKMeans(len(INIT_CENTERS), DECAY, "batches", state_path=f"{base}/state", centers=INIT_CENTERS, weights=INIT_WEIGHTS)
    _train_and_predict(spark, train, test, (text.vectors, text.labeled_points), model,
                       KMeansPredictor(f"{base}/state", f"{base}/predicted", keep=["label"]), base)
    return spark.read.parquet(f"{base}/predicted").select(F.col("label").cast("long").alias("event_id"), "cluster", "version")


def q_stream_linreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12 + S8 + P8: online regression trained on a directory of labelled points, those of another directory predicted by the
    newest committed weights, keyed by the true label: (label, prediction, version)."""
    from netsentry.plans.queries import LR_DIM, _lr_data
    base = scratch_path(spark, "linreg-predict")
    point = F.concat(F.lit("("), F.col("y").cast("string"), F.lit(","), P.vector_text("x"), F.lit(")")).alias("value")
    data = _lr_data(spark, sf_dir)
    train = data.select("batch", point)
    test = data.select(F.pmod("l_orderkey", F.lit(2)).alias("batch"), point)
    model = StreamingLinearRegression([0.0] * LR_DIM, state_path=f"{base}/state")
    _train_and_predict(spark, train, test, (text.labeled_points, text.labeled_points), model,
                       LinearPredictor(f"{base}/state", f"{base}/predicted", keep=["label"]), base)
    return spark.read.parquet(f"{base}/predicted").select(F.round("label", 9).alias("label"), F.round("prediction", 9).alias("prediction"), "version")


def _text_stream(spark: SparkSession, lines: DataFrame, tag: Callable, name: str, trigger_bytes: int) -> tuple[DataFrame, DataFrame]:
    base = scratch_path(spark, name)
    files.write_text(lines, f"{base}/source")
    _drain(files.stream_text(spark, f"{base}/source", trigger_bytes, "\n"), text.TaggedSink(tag, f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out/good"), spark.read.parquet(f"{base}/out/rejects")


def q_stream_text_vectors(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """S8 + P7: vectors written as text files, dense and sparse, streamed through the vector parser. Some lines are
    no vectors: (n, first, last, rejected line)."""
    from netsentry.plans.queries import _sparsified
    arr, m, key = _sparsified(F.col("embedding")), F.pmod(F.col("vec_id"), F.lit(7)), F.col("vec_id").cast("string")
    line = F.when(m == 0, F.concat(F.lit("[1.0,x"), key, F.lit("]"))).when(m == 1, F.concat(F.lit("(3,["), F.lit("5],["), key, F.lit("])"))) \
        .when(F.pmod(F.col("vec_id"), F.lit(2)) == 1, P.vector_text(arr, sparse=True)).otherwise(P.vector_text(arr))
    good, bad = _text_stream(spark, S.embeddings(spark, sf_dir).select(line.alias("value")), text.tagged_vectors, "text-vectors", trigger_bytes)
    none = F.lit(None)
    return good.select(F.size("features").alias("n"), F.get("features", F.lit(0)).alias("first"), F.get("features", F.size("features") - 1).alias("last"), none.cast("string").alias("line")) \
        .unionByName(bad.select(none.cast("int").alias("n"), none.cast("double").alias("first"), none.cast("double").alias("last"), F.col("value").alias("line")))


def q_stream_text_points(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """S8 + P8: labelled points written as text files and streamed through their parser; the labels are ids.
    (vec_id, slot, value) of good lines, (line, reason) of the others."""
    m, key = F.pmod(F.col("vec_id"), F.lit(9)), F.col("vec_id").cast("string")
    vec = P.vector_text("embedding")
    line = F.when(m == 0, F.concat(F.lit("(x"), key, F.lit(",[1.0])"))).when(m == 1, F.concat(F.lit("("), key, F.lit(",[1.0,])"))) \
        .when(m == 2, F.concat(F.lit("("), key, F.lit("), "), vec)).when(m == 3, F.concat(key, F.lit(","), F.array_join(F.col("embedding").cast("array<string>"), " "))) \
        .otherwise(F.concat(F.lit("("), key, F.lit(","), vec, F.lit(")")))
    good, bad = _text_stream(spark, S.embeddings(spark, sf_dir).select(line.alias("value")), text.tagged_points, "text-points", trigger_bytes)
    none = F.lit(None)
    return good.select(F.col("label").cast("long").alias("vec_id"), F.posexplode("features").alias("slot", "value")) \
        .select("vec_id", F.col("slot").cast("int"), "value", none.cast("string").alias("line"), none.cast("string").alias("reason")) \
        .unionByName(bad.select(none.cast("long").alias("vec_id"), none.cast("int").alias("slot"), none.cast("double").alias("value"), F.col("value").alias("line"), "reason"))


STREAM_QUERIES = {
    "stream_lines": q_stream_lines,
    "stream_union": q_stream_union,
    "score_stream": q_score_stream,
    "score_stream_as_batch": q_score_stream_as_batch,
    "two_hop_stream": q_two_hop_stream,
    "two_hop_nearest": q_two_hop_nearest,
    "stream_kmeans_stream": q_stream_kmeans_stream,
    "stream_linreg_stream": q_stream_linreg_stream,
    "weight_lines": q_weight_lines,
    "stream_kmeans_predict": q_stream_kmeans_predict,
    "stream_linreg_predict": q_stream_linreg_predict,
    "stream_text_vectors": q_stream_text_vectors,
    "stream_text_points": q_stream_text_points,
}
