"""The record and message source at size: tasks, lines made once."""

import collections

from pyspark.sql import functions as F

from netsentry.plans import standins as S
from netsentry.plans import stream_queries as Q


def _events(spark, path, n):
    spark.range(n, numPartitions=1).select(
        F.col("id").alias("event_id"), (F.col("id") % 13).alias("user_id"),
        F.when(F.col("id") % 4 > 0, "click").alias("event_type"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.75).alias("value")).write.parquet(f"{path}/events.parquet")


def test_large_event_tables_are_read_by_more_tasks_with_the_same_messages(spark, tmp_path, monkeypatch):
    _events(spark, tmp_path, 500)
    plain = S.events(spark, str(tmp_path))
    want = collections.Counter(r[0] for r in plain.select(S.event_message(S.event_line_corrupted())).collect())
    for per_task, tasks in ((500, 1), (100, 5)):
        monkeypatch.setattr(Q, "EVENTS_PER_TASK", per_task)
        got = Q._event_messages(spark, str(tmp_path))
        assert collections.Counter(r.value for r in got.collect()) == want
        assert got.select(F.spark_partition_id()).distinct().count() == tasks


def test_an_event_line_is_made_once(spark, tmp_path):
    _events(spark, tmp_path, 20)
    plan = Q._event_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1
