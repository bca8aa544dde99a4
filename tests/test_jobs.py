"""Job logs, hand-over and due batches: streams with restarts against plain loops, and their twins over history."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events, jobs


def arriving(spark, path, shape):
    """A stream of files and a way to add one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STORE)

    def add(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)

    return add, lambda: spark.readStream.schema(shape).parquet(path)


def run(frame, out, mode="append"):
    got = []
    query = frame.writeStream.outputMode(mode).foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", out).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return got


def plain_log(rows, now, cap, expire):
    """What each job's log holds, event by event."""
    held, last = defaultdict(list), {}
    for job, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if at > now:
            continue
        if job in last and at >= last[job] + expire:
            held[job] = []
        held[job], last[job] = [*held[job], event][-cap:], at
    return {j: ids for j, ids in held.items() if now < last[j] + expire}


def test_log_of_history(spark):
    rng = random.Random(3)
    at, rows = defaultdict(int), []
    for i in range(400):
        job = rng.choice("abc")
        at[job] += rng.choice([0, 5, 20, 90, 101, 400])
        rows.append((job, i, at[job]))
    frame = spark.createDataFrame(rows, "job_id string, event_id long, at_ms long")
    for now, cap in ((rows[200][2] + 10, 2), (rows[-1][2] + 50, 500)):
        got = defaultdict(list)
        for r in jobs.log_at(frame, now, cap, 100, range_rows=80).orderBy("at_ms", "event_id").collect():
            got[r["job_id"]].append(r["event_id"])
        assert got == plain_log(rows, now, cap, 100) and got


def test_log_of_a_stream_restarts_and_expires(spark, tmp_path):
    add, stream = arriving(spark, str(tmp_path / "in"), "job_id string, event_id long, at timestamp")
    frame = lambda: jobs.capped_log(stream(), 3, 60_000, "0 seconds")
    from datetime import datetime, timedelta

    when = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    add([("a", i, when(i)) for i in range(5)] + [("b", 9, when(2))])
    got = {r["job_id"]: (r["event_ids"], r["expired"]) for r in run(frame(), str(tmp_path / "c"), "update")}
    assert got == {"a": ([2, 3, 4], False), "b": ([9], False)}
    # After a restart the log goes on; b is quiet for a minute while a is not.
    add([("a", 5, when(50))])
    assert {r["job_id"]: r["event_ids"] for r in run(frame(), str(tmp_path / "c"), "update")} == {"a": [3, 4, 5]}
    add([("a", 6, when(70))])
    got = [(r["job_id"], r["event_ids"], r["expired"]) for r in run(frame(), str(tmp_path / "c"), "update")]
    assert ("a", [4, 5, 6], False) in got and ("b", [], True) in got and len(got) == 2


def test_follow_hands_over_without_loss(spark, tmp_path):
    shape = "event_id long, type string, tenant_id string"
    add, stream = arriving(spark, str(tmp_path / "in"), shape)
    # The stream repeats part of the log and brings an id below the log's last one.
    log = spark.createDataFrame([(i, "x", "t") for i in (3, 4, 6, 7)] + [(5, "x", "other")], shape)
    out = str(tmp_path / "out")
    add([(6, "x", "t"), (7, "x", "t"), (8, "x", "t"), (5, "y", "t"), (9, "x", "other"), (2, "x", "t")])
    jobs.follow(log, stream(), 2, "t", out).awaitTermination(120)
    add([(10, "x", "t"), (7, "x", "t")])
    jobs.follow(log.where("false"), stream(), 2, "t", out).awaitTermination(120)
    parts = [sorted(r["event_id"] for r in spark.read.parquet(f"{out}/{p}").collect()) for p in ("replay", "tail")]
    assert parts == [[3, 4, 6, 7], [5, 8, 10]]


def test_due_batches_fire_once(spark, tmp_path):
    shape = "job_id string, schema_version long, extraction_id long"
    add, stream = arriving(spark, str(tmp_path / "in"), shape)
    add([("a", 1, 1), ("a", 1, 2), ("b", 1, 7)])
    assert run(jobs.due_batches(stream(), 3), str(tmp_path / "c")) == []
    add([("a", 1, 3), ("a", 1, 4), ("a", 2, 5), ("b", 1, 7)])
    assert [tuple(r) for r in run(jobs.due_batches(stream(), 3), str(tmp_path / "c"))] == [("a", 1, [1, 2, 3])]
    add([("a", 1, 8), ("a", 1, 9), ("a", 1, 10), ("a", 2, 11), ("a", 2, 12)])
    assert [tuple(r) for r in run(jobs.due_batches(stream(), 3), str(tmp_path / "c"))] == [("a", 2, [5, 11, 12])]
    history = spark.read.schema(shape).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, jobs.batches_due(history, 3).collect())) == [("a", 1, [1, 2, 3]), ("a", 2, [5, 11, 12])]


@pytest.mark.parametrize("rows", [[], [("a", None, None)]])
def test_odd_history(spark, rows):
    assert jobs.log_at(spark.createDataFrame(rows, "job_id string, event_id long, at_ms long"), 10).count() == 0
