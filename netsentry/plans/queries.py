"""Registered queries: one per inventory item, each ``(spark, sf_dir) ->
DataFrame`` over whole test tables. Output columns are scalars (vectors are
exploded to ``slot``/``value`` rows) and doubles are rounded, so that the
SQL twins in ``plans.oracles`` compare exactly."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.functions import parse as P
from netsentry.functions import records as R
from netsentry.functions import vectors as V
from netsentry.operators import classify, cluster, features, forest, regression, text, word_vectors
from netsentry.plans import pipelines
from netsentry.plans import standins as S
from netsentry.session import scratch_path
from netsentry.sources import files, models
from netsentry.streaming import kmeans as SK
from netsentry.streaming import topology


def r9(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------ vectors, M3, A3
def _embed_centers(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    return emb, S.first_centers(emb, "vec_id", "embedding", S.K_EMBED)


def q_nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb, centers = _embed_centers(spark, sf_dir)
    return cluster.assign(emb.select("vec_id", "embedding"), "embedding", centers).select("vec_id", "cluster")


def q_distance_to_centers(spark, sf_dir):
    emb, centers = _embed_centers(spark, sf_dir)
    d = cluster.with_distances(emb.select("vec_id", "embedding"), "embedding", centers, "d")
    return d.select("vec_id", F.posexplode("d").alias("center", "dist")) \
        .select("vec_id", F.col("center").cast("int"), r9("dist").alias("dist"))


def q_wssse(spark, sf_dir):
    emb, centers = _embed_centers(spark, sf_dir)
    return cluster.wssse(emb, "embedding", centers).select(r6("wssse").alias("wssse"), "n")


def q_cluster_cost(spark, sf_dir):
    emb, centers = _embed_centers(spark, sf_dir)
    return cluster.cluster_cost(emb, "embedding", centers).select("cluster", "n", r6("cost").alias("cost"))


def q_lloyd_step(spark, sf_dir):
    emb, centers = _embed_centers(spark, sf_dir)
    st = cluster.lloyd_step(emb, "embedding", centers)
    return st.select("cluster", "n", F.posexplode("center").alias("slot", "value")) \
        .select("cluster", "n", F.col("slot").cast("int"), r9("value").alias("value"))


def q_top_similar(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    first = emb.agg(F.min("vec_id")).first()[0]
    return text.top_similar(emb, "vec_id", "embedding", first, 5) \
        .select("vec_id", r9("similarity").alias("similarity"))


def q_kmeans_fit(spark, sf_dir):
    """M1, M2: k-means|| start drawn by a hash of the id, then Lloyd iterations to the fixpoint (20 at most)."""
    emb = S.embeddings(spark, sf_dir)
    start = cluster.parallel_init(emb, "vec_id", "embedding", S.K_EMBED, steps=INIT_STEPS, seed=1)
    fitted, _ = cluster.lloyd_fit(emb, "embedding", start, LLOYD_STEPS, 0.0, with_costs=False)
    out = cluster.assign(emb.select("vec_id", "embedding"), "embedding", fitted, keep_distances=True)
    return out.select("vec_id", "cluster", r6(F.array_min("_ns_d")).alias("cost"))


INIT_STEPS, LLOYD_STEPS = 2, 20
ELBOW_KS, ELBOW_STEPS = [2, 3, 4, 5, 6], 5


def q_elbow_sweep(spark, sf_dir):
    """A5 over fixed starts (the vectors of the smallest ids): cost and silhouette for each k."""
    emb = S.embeddings(spark, sf_dir)
    firsts = S.first_centers(emb, "vec_id", "embedding", max(ELBOW_KS))
    out = cluster.elbow_from_starts(emb, "embedding", {k: firsts[:k] for k in ELBOW_KS}, ELBOW_STEPS, 0.0)
    return out.select("k", r6("wssse").alias("wssse"), r6("silhouette").alias("silhouette"))


RANDOM_K, RANDOM_SEED = 30, 7


def q_random_centers(spark, sf_dir):
    """Each vector's nearest of k random centres as wide as the vectors."""
    emb = S.embeddings(spark, sf_dir)
    dim = emb.agg(F.max(F.size("embedding"))).first()[0]
    centers, _ = cluster.random_centers(RANDOM_K, dim, 1.0, RANDOM_SEED)
    out = cluster.assign(emb.select("vec_id", "embedding"), "embedding", centers, keep_distances=True)
    return out.select("vec_id", "cluster", r6(F.array_min("_ns_d")).alias("cost"))


# ------------------------------------------------------------ parsing, P1-P12
def _event_messages(spark, sf_dir, corrupted: bool):
    ev = S.events(spark, sf_dir)
    line = S.event_line_corrupted() if corrupted else S.event_line()
    return ev.select("event_id", S.event_message(line).alias("value"))


def q_explode_records(spark, sf_dir):
    lines = P.explode_records(_event_messages(spark, sf_dir, True), "value", "line", "line_no")
    parts = P.jvm_split("line", ",")
    return lines.select("event_id", "line_no", F.get(parts, 0).alias("head"), F.size(parts).alias("n_fields"))


def q_parse_strict(spark, sf_dir):
    lines = P.explode_records(_event_messages(spark, sf_dir, False), "value", "line", "line_no")
    lines = lines.filter(F.length("line") > 0)  # empty lines carry no record
    good, _ = P.parse_records(lines, R.stream_record_schema(), "line", "strict", keep=["event_id", "line_no"])
    return good


def _lenient(spark, sf_dir):
    lines = P.explode_records(_event_messages(spark, sf_dir, True), "value", "line", "line_no")
    return P.parse_records(lines, R.stream_record_schema(), "line", "lenient", keep=["event_id", "line_no"])


def q_parse_lenient(spark, sf_dir):
    return _lenient(spark, sf_dir)[0]


def q_parse_rejects(spark, sf_dir):
    return _lenient(spark, sf_dir)[1].select("event_id", "line_no", "reason")


def _vec_text(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


def q_parse_dense_vector(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    txt = emb.select("vec_id", _vec_text(F.col("embedding")).alias("t"))
    return txt.select("vec_id", F.posexplode(P.parse_dense_vector("t")).alias("slot", "value")) \
        .select("vec_id", F.col("slot").cast("int"), "value")


def _sparsified(arr):
    """Odd ids: small entries zeroed, to give sparse texts something to skip."""
    return F.when(F.pmod(F.col("vec_id"), F.lit(2)) == 1,
                  F.transform(arr, lambda x: F.when(F.abs(x) < 0.05, F.lit(0.0)).otherwise(x))).otherwise(arr)


def q_parse_vector_text(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    arr = _sparsified(F.col("embedding"))
    txt = F.when(F.pmod(F.col("vec_id"), F.lit(2)) == 1, P.vector_text(arr, sparse=True)) \
        .otherwise(P.vector_text(arr))
    t = emb.select("vec_id", txt.alias("t"))
    return t.select("vec_id", F.posexplode(P.parse_vector("t")).alias("slot", "value")) \
        .select("vec_id", F.col("slot").cast("int"), "value")


def q_parse_labeled_point(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    arr = _sparsified(F.col("embedding"))
    lab = F.col("label").cast("double").cast("string")
    m = F.pmod(F.col("vec_id"), F.lit(3))
    txt = (F.when(m == 0, F.concat(F.lit("("), lab, F.lit(","), P.vector_text(arr), F.lit(")")))
           .when(m == 1, F.concat(F.lit("("), lab, F.lit(","), P.vector_text(arr, sparse=True), F.lit(")")))
           .otherwise(F.concat(lab, F.lit(","), _vec_text(arr))))
    lp = emb.select("vec_id", P.parse_labeled_point(txt).alias("lp"))
    return lp.select("vec_id", F.col("lp.label").alias("label"),
                     F.posexplode("lp.features").alias("slot", "value")) \
        .select("vec_id", "label", F.col("slot").cast("int"), "value")


def _messages(spark, sf_dir):
    emb = S.embeddings(spark, sf_dir)
    ids = [F.concat(F.lit("t"), F.col("vec_id").cast("string")),
           F.concat(F.lit("src"), F.col("label").cast("string")), F.lit("dst")]
    return emb.select("vec_id", P.format_vector_message(ids, F.col("embedding")).alias("msg"))


def q_format_vector_message(spark, sf_dir):
    toks = P.tokenize("msg")
    return _messages(spark, sf_dir).select(
        "vec_id", F.size(toks).alias("n_tokens"),
        F.array_join(F.slice(toks, 1, 3), " ").alias("head"),
        F.size(F.split(F.element_at(toks, -1), ",")).alias("width"))


def q_format_sparse_message(spark, sf_dir):
    """P10: the numbers of messages whose vectors are written as they would be stored (sparse or dense by their zeros),
    taken from the text by string functions: (vec_id, form, width, slot, value), of sparse texts the slots they hold."""
    emb = S.embeddings(spark, sf_dir)
    arr = F.transform("embedding", lambda x: F.when(F.abs(x) < F.when(F.pmod("vec_id", F.lit(2)) == 1, 0.15).otherwise(0.0), F.lit(0.0)).otherwise(x))
    msg = emb.select("vec_id", P.format_vector_message([F.concat(F.lit("t"), F.col("vec_id").cast("string")), F.lit("dst")], arr, "auto").alias("msg"))
    t = msg.select("vec_id", F.substring_index("msg", " ", -1).alias("t")).withColumn("sparse", F.col("t").startswith("("))
    lists = F.regexp_extract_all("t", F.lit(r"\[([^\]]*)\]"), 1)
    numbers = F.split(F.element_at(lists, -1), ",")
    slots = F.when(F.col("sparse"), F.split(lists[0], ",")).otherwise(F.transform(numbers, lambda x, i: i.cast("string")))
    width = F.when(F.col("sparse"), F.regexp_extract("t", r"^\((\d+),", 1).cast("int")).otherwise(F.size(numbers))
    rows = t.select("vec_id", F.when(F.col("sparse"), "sparse").otherwise("dense").alias("form"), width.alias("width"), F.explode(F.arrays_zip(slots.alias("s"), numbers.alias("v"))).alias("e"))
    return rows.select("vec_id", "form", "width", F.col("e.s").cast("int").alias("slot"), F.col("e.v").cast("double").alias("value"))


def q_split_key_vector(spark, sf_dir):
    kv = _messages(spark, sf_dir).select("vec_id", *P.split_key_vector("msg", "key", "vt"))
    return kv.select("vec_id", "key", F.posexplode(P.parse_vector("vt")).alias("slot", "value")) \
        .select("vec_id", "key", F.col("slot").cast("int"), "value")


def _spoiled(spark, sf_dir):
    """Keyed vector messages, some of them no keyed vectors: by id, a word among the
    numbers, a sparse index outside the width, or no key."""
    m = F.pmod(F.col("vec_id"), F.lit(7))
    return _messages(spark, sf_dir).select("vec_id", F.when(m == 0, F.concat(F.lit("k"), "vec_id", F.lit(" [1.0,x]")))
                                           .when(m == 1, F.concat(F.lit("k"), "vec_id", F.lit(" (3,[5],[1.0])")))
                                           .when(m == 2, F.element_at(P.tokenize("msg"), -1)).otherwise(F.col("msg")).alias("value"))


def q_hop2_rejects(spark, sf_dir):
    return topology.hop2_tagged(_spoiled(spark, sf_dir), ["vec_id"]).where("reason is not null").select("vec_id", "reason", "value") \
        .withColumn("value", F.when(F.col("reason") == "bad_vector", F.col("value")))


def q_hop2_vectors(spark, sf_dir):
    """The good messages' vectors, whole."""
    good = topology.hop2_tagged(_spoiled(spark, sf_dir), ["vec_id"]).where("reason is null")
    return good.select("vec_id", "key", F.posexplode("x").alias("slot", "value")).select("vec_id", "key", F.col("slot").cast("int"), "value")


def q_tokenize(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.posexplode(P.tokenize("text")).alias("pos", "token")) \
        .select("doc_id", F.col("pos").cast("int"), "token")


CORRUPT = "corrupt"


def _csv_files(spark, sf_dir, short: bool):
    """S1 + S3: records written as header-less CSV files, with a schema built from a spec. Some lines are bad: every
    11th order's tax is a text; ``short``: of every 13th order the line ends after three fields."""
    from netsentry.sources.spec import schema_from_spec
    spec = "class list.\n" + "\n".join(
        [f"{c}: symbolic." for c in S.LI_SYMBOLIC] + [f"{c}: continuous." for c in S.LI_NUMERIC]) + "\n"
    schema = schema_from_spec(spec, "double", label="label")
    key = S.table(spark, sf_dir, "lineitem", S.LI_KEYS).schema
    li = S.lineitem_records(spark, sf_dir, label=True)
    num = [F.col(c).cast("string") for c in S.LI_NUMERIC]
    order = F.col("l_orderkey")
    tax = F.when(F.pmod(order, F.lit(11)) == 0, F.lit("n/a")).otherwise(num[3])
    whole = F.concat_ws(",", *(F.col(c).cast("string") for c in S.LI_KEYS), F.col("l_returnflag"), F.col("l_linestatus"), num[0], num[1], num[2], tax, F.col("label"))
    line = F.when(F.lit(short) & (F.pmod(order, F.lit(13)) == 0), F.substring_index(whole, ",", 3)).otherwise(whole)
    path = scratch_path(spark, "csv")
    files.write_text(li.select(line.alias("value")), path)
    return path, T.StructType([*key.fields, *schema.fields])


def q_csv_scan(spark, sf_dir):
    """CSV files read with an explicit schema; PERMISSIVE, so a bad number is null."""
    return files.read_csv(spark, *_csv_files(spark, sf_dir, False))


def q_csv_rejects(spark, sf_dir):
    """The lines that could not be read whole, from the corrupt-record column."""
    rows = files.read_csv(spark, *_csv_files(spark, sf_dir, True), corrupt=CORRUPT)
    return rows.where(F.col(CORRUPT).isNotNull()).select("l_orderkey", "l_linenumber", F.col(CORRUPT).alias("line"))


def q_text_scan(spark, sf_dir):
    """S2 + P1: documents written as text files, a line for each of theirs under its id and number, and read back."""
    docs = S.table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = P.explode_records(docs, "text", "line", "line_no")
    path = scratch_path(spark, "text")
    files.write_text(lines.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), "line").alias("value")), path)
    parts = F.split("value", "\t", 3)
    read = files.read_text(spark, path, "\n").select(parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("line_no"), parts[2].alias("line"))
    return read.select("doc_id", "line_no", F.length("line").alias("n_chars"))


# ------------------------------------------------------- features, F1-F6, A1
def _li_index_model(li):
    return features.string_indexer(S.LI_SYMBOLIC).fit(li)


def q_symbolic_cardinality(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem", S.LI_SYMBOLIC)
    od = S.table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"])
    return features.symbolic_cardinality(li, S.LI_SYMBOLIC).unionByName(
        features.symbolic_cardinality(od, ["o_orderpriority", "o_orderstatus"]))


def q_symbolic_cardinality_approx(spark, sf_dir):
    """A1, sketch form: one aggregate of fixed-size HyperLogLog++ sketches
    (exact at these small cardinalities)."""
    li = S.table(spark, sf_dir, "lineitem", S.LI_SYMBOLIC)
    od = S.table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"])
    return features.symbolic_cardinality(li, S.LI_SYMBOLIC, approx=True).unionByName(
        features.symbolic_cardinality(od, ["o_orderpriority", "o_orderstatus"], approx=True))


def q_first_n(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem", S.LI_KEYS + ["l_extendedprice"])
    return li.orderBy(F.col("l_extendedprice").desc(), *S.LI_KEYS).limit(20)


def q_string_index(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    return _li_index_model(li).transform(li).select(*S.LI_KEYS, "l_returnflag_index", "l_linestatus_index")


def q_string_index_unseen(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem", ["l_linestatus"])
    model = StringIndexer(inputCol="l_linestatus", outputCol="status_index", handleInvalid="keep").fit(li)
    od = S.table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    return model.transform(od.withColumnRenamed("o_orderstatus", "l_linestatus")) \
        .select("o_orderkey", "status_index")


def q_one_hot(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    idx = _li_index_model(li).transform(li)
    enc = features.one_hot_encoder(["l_returnflag_index", "l_linestatus_index"]).fit(idx).transform(idx)
    # one pass: each row's vectors as (feature, slots), exploded once
    both = F.array(*[F.struct(F.lit(c).alias("feature"), V.as_double_array(enc, c).alias("x")) for c in ("l_returnflag_Vec", "l_linestatus_Vec")])
    rows = enc.select(*S.LI_KEYS, F.explode(both).alias("v"))
    return rows.select(*S.LI_KEYS, F.posexplode("v.x").alias("slot", "value"), "v.feature").withColumn("slot", F.col("slot").cast("int"))


def q_index_to_label(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    model = _li_index_model(li)
    labels = list(model.labelsArray[0])
    idx = model.transform(li).withColumn(
        "shifted", F.pmod(F.col("l_returnflag_index") + 1, F.lit(float(len(labels)))))
    return features.index_to_label("shifted", labels, "next_label").transform(idx) \
        .select(*S.LI_KEYS, "next_label")


def _feature_model(li, scale=True):
    return features.feature_pipeline(S.LI_SYMBOLIC, S.LI_ASSEMBLER, None, scale=scale).fit(li)


def _exploded(df, vec):
    return V.explode_slots(df, S.LI_KEYS, vec).select(*S.LI_KEYS, "slot", r6("value").alias("value"))


def q_assemble_features(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    return _exploded(_feature_model(li, scale=False).transform(li), R.FEATURES)


def q_standard_scale(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    vec = li.select(*S.LI_KEYS, V.to_vector(F.array(*[F.col(c) for c in S.LI_NUMERIC])).alias(R.FEATURES))
    return _exploded(features.std_scaler().fit(vec).transform(vec), R.SCALED_FEATURES)


def q_pipeline_features(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    return _exploded(_feature_model(li).transform(li), R.SCALED_FEATURES)


def q_model_roundtrip(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    path = scratch_path(spark, "feature-model")
    models.load_or_fit(spark, path, features.feature_pipeline(S.LI_SYMBOLIC, S.LI_ASSEMBLER, None), li)
    loaded = models.load_pipeline(path)
    return _exploded(loaded.transform(li), R.SCALED_FEATURES)


def q_assemble_stage2(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir)
    scaled = _feature_model(li).transform(li).select(*S.LI_ORDER, R.SCALED_FEATURES)
    arr = scaled.select(F.struct(*S.LI_ORDER).alias("_k"), V.as_double_array(scaled, R.SCALED_FEATURES).alias("_x"))
    centers = S.first_centers(arr, "_k", "_x", S.K_LINEITEM)
    staged = pipelines.append_distances(scaled, centers)
    staged = staged.withColumn(R.KMEANS_PREDICTION, V.nearest_center(V.as_double_array(staged, R.DISTANCE_TO_CENTERS)))
    out = features.assembler([R.SCALED_FEATURES, R.DISTANCE_TO_CENTERS, R.KMEANS_PREDICTION],
                             R.ASSEMBLED_FEATURES).transform(staged)
    return _exploded(out, R.ASSEMBLED_FEATURES)


def q_hash_split(spark, sf_dir):
    od = S.table(spark, sf_dir, "orders", ["o_orderkey"])
    return od.select("o_orderkey", features.hash_split_column("o_orderkey", [0.7, 0.3]).alias("split"))


def q_accuracy(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir, label=True).withColumn("prediction", S.lineitem_rule_prediction())
    return classify.accuracy(li, "label", "prediction").select(
        r9("accuracy").alias("accuracy"), "n", r9("test_error").alias("test_error"))


def q_rf_fit_score(spark, sf_dir):
    li = S.lineitem_records(spark, sf_dir, label=True)
    li = li.withColumn("rowkey", F.concat_ws("-", *[F.col(c).cast("string") for c in S.LI_KEYS])).persist()
    try:  # the fits make several passes over the input: read it once
        _, _, scored = pipelines.fit_two_stage(li, S.LI_SYMBOLIC, S.LI_ASSEMBLER, S.K_LINEITEM, "rowkey")
        return pipelines.materialize(scored.select(*S.LI_KEYS, "label", R.PREDICTED_LABEL),
                                     scratch_path(spark, "rf-scored"))
    finally:
        li.unpersist()


FOREST_TREES, FOREST_DEPTH, FOREST_BINS, FOREST_SEED = 3, 2, 16, 1
FOREST_CLASSES = ["bulk.", "discounted.", "normal.", "returned."]


def _forest(spark, sf_dir):
    """M4 with hashed draws, fitted on the connection records, saved as a table and read back."""
    li = S.lineitem_records(spark, sf_dir, label=True)
    rows = li.select(*S.LI_KEYS, F.concat_ws("-", *(F.col(c).cast("string") for c in S.LI_KEYS)).alias("key"),
                     F.array(*(F.col(c).cast("double") for c in S.LI_NUMERIC)).alias("x"),
                     (F.array_position(F.array(*map(F.lit, FOREST_CLASSES)), F.col("label")) - 1).cast("int").alias("y"))
    fitted = forest.fit_forest(rows, "key", "x", "y", len(FOREST_CLASSES), len(S.LI_NUMERIC), FOREST_TREES, FOREST_DEPTH, FOREST_BINS, FOREST_SEED)
    return rows, pipelines.materialize(fitted.to_df(spark), scratch_path(spark, "forest"))


def q_forest_splits(spark, sf_dir):
    """M4: the splits of the forest and what they gain."""
    _, saved = _forest(spark, sf_dir)
    return saved.where("feature is not null").select("tree", "node", "feature", r6("threshold").alias("threshold"), r9("gain").alias("gain"))


def q_forest_predict(spark, sf_dir):
    """M5: each record's class by the saved forest."""
    rows, saved = _forest(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, FOREST_CLASSES)), forest.predict("x", forest.Forest.from_df(saved)) + 1)
    return rows.select(*S.LI_KEYS, label.alias("predicted"))


# --------------------------------------------------------- streaming k-means
INIT_CENTERS = [[0.0], [50.0]]
INIT_WEIGHTS = [0.0, 0.0]
DECAY = 0.95


def _event_values(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    return ev.select("event_id", S.event_batch().alias("batch"), F.array(F.col("value")).alias("x"))


def _event_fold(spark, sf_dir):
    return SK.kmeans_fold(_event_values(spark, sf_dir), "x", "batch", SK.KMeansState.of(INIT_CENTERS, INIT_WEIGHTS), DECAY,
                          batches=range(S.N_BATCHES))


def _folded_assignments(spark, data, vec, keep):
    """Each batch scored by the model after training on it (train, then predict)."""
    out = scratch_path(spark, "assignments")
    SK.kmeans_fold(data, vec, "batch", SK.KMeansState.of(INIT_CENTERS, INIT_WEIGHTS), DECAY, batches=range(S.N_BATCHES), keep=keep, out_path=out)
    return spark.read.parquet(out).select(*keep, "cluster")


def q_stream_kmeans_step(spark, sf_dir):
    ev = S.events(spark, sf_dir).select(F.array(F.col("value")).alias("x"))
    st = SK.kmeans_step(SK.KMeansState.of([[0.0], [50.0]], [1.0, 1.0]), ev, "x", 0.5)
    return SK.trace_to_df(spark, [(0, st)]).select(
        "cluster", r6("weight").alias("weight"), r6(F.col("center")[0]).alias("center"))


def q_stream_kmeans_fold(spark, sf_dir):
    trace = _event_fold(spark, sf_dir)
    return SK.trace_to_df(spark, trace[-1:]).select(
        "cluster", r6("weight").alias("weight"), r6(F.col("center")[0]).alias("center"))


def q_stream_kmeans_weights(spark, sf_dir):
    trace = _event_fold(spark, sf_dir)
    return SK.trace_to_df(spark, trace).select("batch", "cluster", r6("weight").alias("weight"))


def q_stream_kmeans_assign(spark, sf_dir):
    return _folded_assignments(spark, _event_values(spark, sf_dir), "x", ["event_id"])


EMBED_DECAY = 0.9


def q_kmeans_fold_embeddings(spark, sf_dir):
    """M6 + M9 at k = 5 and the vectors' width: the model after each of three batches, the start at the vectors of the smallest
    ids with weight 0: (batch, cluster, weight, slot, value)."""
    emb, centers = _embed_centers(spark, sf_dir)
    data = emb.select(F.pmod("vec_id", F.lit(S.N_BATCHES)).alias("batch"), "embedding")
    trace = SK.kmeans_fold(data, "embedding", "batch", SK.KMeansState.of(centers, [0.0] * S.K_EMBED), EMBED_DECAY, batches=range(S.N_BATCHES))
    rows = SK.trace_to_df(spark, trace)
    return rows.select("batch", "cluster", r6("weight").alias("weight"), F.posexplode("center").alias("slot", "value")) \
        .select("batch", "cluster", "weight", F.col("slot").cast("int"), r6("value").alias("value"))


def q_two_hop_cluster(spark, sf_dir):
    """T2 as one plan: hop 1 parses the record lines and writes
    ``ts src dst [vector]`` messages; hop 2 splits key and vector and runs the
    online k-means, then assigns."""
    ev = S.events(spark, sf_dir)
    lines = ev.select("event_id", S.event_batch().alias("batch"), S.event_line().alias("line"))
    rec, _ = P.parse_records(lines, R.stream_record_schema(), "line", "strict", keep=["batch"])
    msgs = rec.select("batch", P.format_vector_message(["timeStamp", "srcIp", "desIp"],
                                                       F.array(F.col("duration"))).alias("msg"))
    kv = msgs.select("batch", *P.split_key_vector("msg", "key", "vt"))
    data = kv.select("batch", "key", P.parse_vector("vt").alias("x"))
    return _folded_assignments(spark, data, "x", ["key"])


# ------------------------------------------------------------- regression
LR_DIM = 3


def _lr_data(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem", S.LI_KEYS + LI_LR_COLS)
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    return li.select(*S.LI_KEYS, F.pmod(F.col("l_orderkey"), F.lit(S.N_BATCHES)).alias("batch"),
                     x.alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))


LI_LR_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def q_stream_linreg_fold(spark, sf_dir):
    trace = regression.linreg_fold(_lr_data(spark, sf_dir), "x", "y", "batch", [0.0] * LR_DIM)
    w = trace[-1][1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "slot int, weight double") \
        .select("slot", r9("weight").alias("weight"))


def q_linreg_embeddings(spark, sf_dir):
    """M11 at the vectors' width: the weights after three batches of (a number of the label and the id, vector)."""
    emb = S.embeddings(spark, sf_dir)
    dim = emb.agg(F.max(F.size("embedding"))).first()[0]
    y = F.col("label") / 10.0 + F.pmod("vec_id", F.lit(7)) / 20.0
    data = emb.select(F.pmod("vec_id", F.lit(S.N_BATCHES)).alias("batch"), "embedding", y.alias("y"))
    w = regression.linreg_fold(data, "embedding", "y", "batch", [0.0] * dim)[-1][1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "slot int, weight double").select("slot", r9("weight").alias("weight"))


def q_assignment_lines(spark, sf_dir):
    """The ``key cluster`` lines that hop 2 publishes."""
    return topology.assignment_lines(q_two_hop_cluster(spark, sf_dir))


def q_linreg_predict(spark, sf_dir):
    data = _lr_data(spark, sf_dir)
    w = regression.linreg_fold(data, "x", "y", "batch", [0.0] * LR_DIM)[-1][1]
    return data.select(*S.LI_KEYS, r9("y").alias("label"), r9(regression.linreg_predict("x", w)).alias("prediction"))


# ------------------------------------------------------------------- text
def q_word2vec_fit(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents", ["text"])
    toks = docs.select(P.tokenize("text").alias("tokens"))
    model = text.parallel_word2vec(toks, "tokens", seed=42).fit(toks)
    return model.getVectors().select("word")


def q_word_vectors(spark, sf_dir):
    """M13, trained in shards: each word of the vocabulary with its vector's width, whether all its components are finite and
    whether it has left its start."""
    toks = S.table(spark, sf_dir, "documents", ["text"]).select(P.tokenize("text").alias("tokens"))
    vectors = word_vectors.fit_word_vectors(toks, "tokens", size=100, min_count=5, window=3, negatives=1, passes=1, shards=8)
    x = F.col("vector")
    return vectors.select("word", F.size(x).alias("width"), F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"),
                          F.exists(x, lambda v: F.abs(v) > 0.005).alias("moved"))


def q_synonyms(spark, sf_dir):
    """M14, word level: the words most similar to the most frequent one, by the vectors of a model fitted on the documents."""
    toks = S.table(spark, sf_dir, "documents", ["text"]).select(P.tokenize("text").alias("tokens"))
    word = text.vocabulary(toks, "tokens", 5).where("word <> ''").orderBy(F.desc("n"), "word").first()["word"]
    return text.synonyms(text.parallel_word2vec(toks, "tokens", seed=42).fit(toks), word, 10)


def q_vocabulary(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents", ["text"])
    return text.vocabulary(docs.select(P.tokenize("text").alias("tokens")), "tokens", 5)


QUERIES = {
    # vectors, clustering
    "nearest_center": q_nearest_center,
    "distance_to_centers": q_distance_to_centers,
    "wssse": q_wssse,
    "cluster_cost": q_cluster_cost,
    "lloyd_step": q_lloyd_step,
    "top_similar": q_top_similar,
    "kmeans_fit": q_kmeans_fit,
    "elbow_sweep": q_elbow_sweep,
    # sources and parsing
    "random_centers": q_random_centers,
    "csv_scan": q_csv_scan,
    "csv_rejects": q_csv_rejects,
    "text_scan": q_text_scan,
    "explode_records": q_explode_records,
    "parse_strict": q_parse_strict,
    "parse_lenient": q_parse_lenient,
    "parse_rejects": q_parse_rejects,
    "parse_dense_vector": q_parse_dense_vector,
    "parse_vector_text": q_parse_vector_text,
    "parse_labeled_point": q_parse_labeled_point,
    "format_vector_message": q_format_vector_message,
    "format_sparse_message": q_format_sparse_message,
    "split_key_vector": q_split_key_vector,
    "hop2_rejects": q_hop2_rejects,
    "hop2_vectors": q_hop2_vectors,
    "tokenize": q_tokenize,
    # features, metrics
    "symbolic_cardinality": q_symbolic_cardinality,
    "symbolic_cardinality_approx": q_symbolic_cardinality_approx,
    "first_n": q_first_n,
    "string_index": q_string_index,
    "string_index_unseen": q_string_index_unseen,
    "one_hot": q_one_hot,
    "index_to_label": q_index_to_label,
    "assemble_features": q_assemble_features,
    "standard_scale": q_standard_scale,
    "pipeline_features": q_pipeline_features,
    "model_roundtrip": q_model_roundtrip,
    "assemble_stage2": q_assemble_stage2,
    "hash_split": q_hash_split,
    "accuracy": q_accuracy,
    "rf_fit_score": q_rf_fit_score,
    "forest_splits": q_forest_splits,
    "forest_predict": q_forest_predict,
    # streaming models
    "stream_kmeans_step": q_stream_kmeans_step,
    "stream_kmeans_fold": q_stream_kmeans_fold,
    "stream_kmeans_weights": q_stream_kmeans_weights,
    "stream_kmeans_assign": q_stream_kmeans_assign,
    "kmeans_fold_embeddings": q_kmeans_fold_embeddings,
    "two_hop_cluster": q_two_hop_cluster,
    "assignment_lines": q_assignment_lines,
    "stream_linreg_fold": q_stream_linreg_fold,
    "linreg_embeddings": q_linreg_embeddings,
    "linreg_predict": q_linreg_predict,
    # text
    "word2vec_fit": q_word2vec_fit,
    "word_vectors": q_word_vectors,
    "synonyms": q_synonyms,
    "vocabulary": q_vocabulary,
}
