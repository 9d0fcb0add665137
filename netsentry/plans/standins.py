"""Stand-ins: the test tables re-read as the workload's inputs.

The test tables hold no connection records, so each operator runs on a
stand-in derived from them by column expressions (no row is dropped, no
subset is taken):

* ``lineitem`` - connection records: symbolic ``l_returnflag``,
  ``l_linestatus``; continuous quantity, price, discount, tax; a class label
  made from those numbers by a fixed rule, so that it can be learned.
* ``events`` - streamed record lines (31 comma fields) and micro-batches
  (``event_id % 3``), some lines made bad on purpose by id.
* ``embeddings`` - 64-wide vectors, the online path's width.
* ``documents`` - text lines.

Every rule here has an SQL twin in ``plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.functions import records as R

# Fixed values of the stand-in pipeline.
LI_KEYS = ["l_orderkey", "l_linenumber"]  # not unique: a row is identified by all its used columns
# A total order on the stand-in rows: equal rows under it have equal features.
LI_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
LI_SYMBOLIC = ["l_returnflag", "l_linestatus"]
LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Assembler order interleaves numbers and one-hot vectors, as the original does.
LI_ASSEMBLER = ["l_quantity", "l_returnflag_Vec", "l_extendedprice", "l_linestatus_Vec", "l_discount", "l_tax"]
N_BATCHES = 3
K_EMBED = 5
K_LINEITEM = 3


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """A test table; selecting ``cols`` here lets the scan read only them. Scan
    parallelism is the session's (``spark.sql.files.maxPartitionBytes``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# ------------------------------------------------------------------ lineitem
def lineitem_label() -> Column:
    return (F.when(F.col("l_discount") >= 0.06, F.lit("discounted."))
            .when(F.col("l_quantity") >= 40, F.lit("bulk."))
            .when(F.col("l_returnflag") == "R", F.lit("returned."))
            .otherwise(F.lit("normal.")))


def lineitem_rule_prediction() -> Column:
    """A rule-made prediction, for the accuracy check."""
    return (F.when(F.col("l_discount") >= 0.06, F.lit("discounted."))
            .when(F.col("l_quantity") >= 45, F.lit("bulk."))
            .otherwise(F.lit("normal.")))


def lineitem_records(spark: SparkSession, sf_dir: str, label: bool = False) -> DataFrame:
    cols = LI_KEYS + LI_SYMBOLIC + LI_NUMERIC
    df = table(spark, sf_dir, "lineitem", cols)
    return df.withColumn("label", lineitem_label()) if label else df


# ------------------------------------------------------------------- events
def _num(c: Column) -> Column:
    return c.cast("double").cast("string")


def event_fields() -> list[Column]:
    """The 31 stream-record fields of an event, as strings."""
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    fields = [
        F.concat(F.lit("t"), eid.cast("string")),                          # timeStamp
        F.concat(F.lit("u"), uid.cast("string")),                          # srcIp
        F.col("event_type"),                                               # desIp
        _num(val),                                                         # duration
        F.col("event_type"),                                               # protocol_type
        F.concat(F.lit("svc"), F.pmod(uid, F.lit(7)).cast("string")),      # service
        F.when(val > 100, F.lit("S0")).otherwise(F.lit("SF")),             # flag
        _num(val * 10),                                                    # src_bytes
        _num(uid),                                                         # dst_bytes
        F.when(F.pmod(uid, F.lit(2)) == 0, F.lit("0")).otherwise(F.lit("1")),  # land
    ]
    # the 21 remaining numeric fields: event_id mod 2..22
    fields += [_num(F.pmod(eid, F.lit(m))) for m in range(2, 23)]
    assert len(fields) == len(R.STREAM_RECORD_FIELDS)
    return fields


def event_line() -> Column:
    return F.concat_ws(",", *event_fields())


def event_line_corrupted() -> Column:
    """Lines with some damage by id: a text duration (id % 17 = 0) or only
    20 fields (id % 19 = 0, checked first)."""
    f = event_fields()
    bad_num = F.concat_ws(",", *(f[:3] + [F.lit("x")] + f[4:]))
    short = F.concat_ws(",", *f[:20])
    eid = F.col("event_id")
    return (F.when(F.pmod(eid, F.lit(19)) == 0, short)
            .when(F.pmod(eid, F.lit(17)) == 0, bad_num)
            .otherwise(F.concat_ws(",", *f)))


def event_message(line: Column) -> Column:
    """A message per event, every event's record kept: usually one line; two
    lines (the second with a ``b`` time stamp) when id % 5 = 0; a trailing
    newline when id % 7 = 0; an empty first line before the record when
    id % 23 = 0."""
    eid = F.col("event_id")
    second = F.regexp_replace(line, "^([^,]*)", "$1b")
    return (F.when(F.pmod(eid, F.lit(23)) == 0, F.concat(F.lit("\n"), line))
            .when(F.pmod(eid, F.lit(5)) == 0, F.concat_ws("\n", line, second))
            .when(F.pmod(eid, F.lit(7)) == 0, F.concat(line, F.lit("\n")))
            .otherwise(line))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])


def event_batch() -> Column:
    return F.pmod(F.col("event_id"), F.lit(N_BATCHES))


# --------------------------------------------------------------- embeddings
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return df.withColumn("embedding", F.col("embedding").cast("array<double>"))


def first_centers(df: DataFrame, key: str, vec: str, k: int) -> list[list[float]]:
    """Initial centres: the vectors of the k smallest keys (a top-k of k
    rows; only those reach the driver)."""
    rows = df.select(key, vec).orderBy(key).limit(k).collect()
    return [[float(x) for x in r[vec]] for r in rows]
