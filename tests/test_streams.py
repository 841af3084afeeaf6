"""Streams that stop and go on."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import fold
from ledgerloom.streaming import project

EVENTS = "user_id bigint, event_id bigint, event_type string"


def test_projection_goes_on_after_a_restart(spark, tmp_path):
    rows = [(u, 10 * i + u, t) for i, t in enumerate(("view", "click", "error")) for u in (1, 2)]
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = project.event_stream(spark, f"{tmp_path}/events")  # a new one, as after a restart
        got = sorted(map(tuple, project.project(spark, stream, f"{tmp_path}/out").collect()))
        assert got == [(u, i + 1, 10 * i + u, ("view", "click", "error")[i]) for u in (1, 2)]
    again = project.project(spark, project.event_stream(spark, f"{tmp_path}/events"), f"{tmp_path}/out")  # nothing new
    assert sorted(map(tuple, again.collect())) == got


def test_documents_fold_the_same_in_batches(spark, tmp_path):
    change = lambda i: json.dumps([{"op": "set", "path": ["f"], "value": i}])
    rows = [("a", 1, "c", "snapshot.create", None, "[]"), ("a", 2, "p1", "snapshot.patch", 1, change(1)), ("b", 3, "x", "snapshot.patch", 1, change(1)), ("a", 4, "p2", "snapshot.patch", 1, change(2)), ("a", 5, "r", "conflict.resolve", None, change(3)), ("a", 6, "p3", "snapshot.patch", 3, change(4)), ("b", 7, "c2", "snapshot.create", None, "[]"), ("a", 8, "d", "snapshot.delete", None, None), ("a", 9, "p4", "snapshot.patch", 4, change(5))]
    schema = "node_id string, event_seq bigint, request_id string, operation string, base_revision bigint, changes string"
    for cut in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
        out = project.fold_stream(spark, project.event_stream(spark, f"{tmp_path}/requests"), f"{tmp_path}/out")
    want = fold.fold_snapshots(spark.createDataFrame(rows, schema))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert {r["request_id"]: r["effect"] for r in out.collect()} == {"c": "applied", "p1": "applied", "x": "cancelled", "p2": "conflict", "r": "applied", "p3": "applied", "c2": "applied", "d": "applied", "p4": "cancelled"}
    spark.createDataFrame([("b", 2, "slow", "snapshot.patch", 1, change(9))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
    late = project.fold_stream(spark, project.event_stream(spark, f"{tmp_path}/requests"), f"{tmp_path}/out").where("effect = 'late'")
    assert [r["request_id"] for r in late.collect()] == ["slow"]


def test_a_generation_counts_when_it_is_complete(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "view")], EVENTS)
    assert project.rebuild(spark, events, str(tmp_path), 1).count() == 1
    os.makedirs(tmp_path / "generation=2" / "_temporary")  # a writer that has died
    assert project.current(spark, str(tmp_path)).endswith("generation=1")
    more = events.union(spark.createDataFrame([(2, 2, "view")], EVENTS))
    assert project.rebuild(spark, more, str(tmp_path), 10).count() == 2
    assert spark.read.parquet(f"{tmp_path}/generation=1").count() == 1


@pytest.mark.parametrize("now,want", [("2024-01-01 00:00:05", ["b", "a"]), ("2023-01-01 00:00:00", [])])
def test_due_outbox(spark, now, want):
    from ledgerloom.operators import work

    rows = [("a", "local_pending", "2024-01-01 00:00:03"), ("b", "local_pending", "2024-01-01 00:00:01"), ("c", "sending", "2024-01-01 00:00:00"), ("d", "local_pending", "2024-01-01 00:00:09")]
    df = spark.createDataFrame(rows, "request_id string, state string, available_at string").withColumn("available_at", F.col("available_at").cast("timestamp"))
    assert [r["request_id"] for r in work.due_outbox(df, F.lit(now).cast("timestamp"), 2).collect()] == want
