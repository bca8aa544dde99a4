import json
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators.actions import JOB_STEPS, triage
from tessera.operators.evolve import Field, Schema
from tessera.operators.tables import check_transitions
from tessera.sources import sinks
from tessera.sources.tables import contents, log_lines, project, pulled_since
from tessera.streaming import events

SCHEMA = Schema(3, (Field("name", required=True), Field("price", "number"), Field("tags", "array"), Field("open", "boolean")))


@pytest.fixture
def entities(spark):
    rows = [("e1", {"name": '"A, B"', "price": "-2.5", "tags": '["x"]', "open": "true"}, 0.9, ["c"], 2), ("e2", {"name": '"=C"', "price": '"odd"'}, 0.4, [], 1)]
    return spark.createDataFrame(rows, "entity string, data map<string,string>, quality double, categories array<string>, source_count long").coalesce(1)


def test_files(spark, entities, tmp_path):
    sinks.write_parquet(entities, SCHEMA, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).orderBy("entity").collect()
    assert [tuple(r) for r in back] == [("e1", "A, B", -2.5, '["x"]', True), ("e2", "=C", None, None, None)]
    assert "".join(sinks.stream_csv(entities, SCHEMA)) == 'name,price,tags,open\n"A, B","\t-2.5","[""x""]",true\n"\t=C",odd,,\n'
    assert list(sinks.stream_csv(entities.where("false"), SCHEMA)) == []
    rows = json.loads("".join(sinks.stream_json(entities)))
    assert rows[0] == {"data": {"name": "A, B", "open": True, "price": -2.5, "tags": ["x"]}, "qualityScore": 0.9, "categories": ["c"], "sourceCount": 2}
    assert json.loads("".join(sinks.stream_json(entities, fields=["name"])))[1]["data"] == {"name": "=C"}
    assert json.loads(sinks.envelope("j", SCHEMA, 2, "now"))["metadata"]["schemaVersion"] == 3


def test_database_files(entities, tmp_path):
    assert sinks.write_sqlite(entities, SCHEMA, str(tmp_path / "a.sqlite")) == 2
    assert sqlite3.connect(tmp_path / "a.sqlite").execute("SELECT name, price, open FROM entities ORDER BY name DESC").fetchall() == [("A, B", -2.5, 1), ("=C", None, None)]
    assert sinks.write_duckdb(entities, SCHEMA, str(tmp_path / "a.duckdb")) == 2
    assert duckdb.connect(str(tmp_path / "a.duckdb")).execute("SELECT count(*), min(price) FROM entities").fetchall() == [(2, -2.5)]
    with pytest.raises(ValueError):
        sinks.write_sqlite(entities, SCHEMA, str(tmp_path / "b.sqlite"), limit=1)


def test_signature():
    assert sinks.signature("key", "The quick brown fox jumps over the lazy dog") == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


def test_sources(spark, tmp_path):
    (tmp_path / "store" / "a").mkdir(parents=True)
    (tmp_path / "store" / "a" / "k.html").write_text("x\ny")
    assert [tuple(r) for r in contents(spark, str(tmp_path / "store")).collect()] == [("a/k.html", "x\ny")]
    (tmp_path / "log").write_text('{"level":"info","message":"m"}\nbroken\n{"level":"error","message":"e"}\n')
    assert [r["message"] for r in log_lines(spark, str(tmp_path / "log"), "error").collect()] == ["e"]
    remote, local = spark.createDataFrame([(1, 5), (2, 6), (3, 6), (4, 7)], "id long, t long"), spark.createDataFrame([(1, 5), (2, 6)], "id long, t long")
    assert {r["id"] for r in pulled_since(remote, local, "t", "id").collect()} == {3, 4}


def test_project():
    p = project("name: n\nseeds: [https://a.b]\nfields:\n  title: string\n  price: {type: currency, required: true}\n")
    assert p.mode == "hybrid" and [f.type for f in p.fields] == ["string", "currency"] and p.fields[1].required
    assert project("name: n\nseeds: [x]").mode == "discovery"
    with pytest.raises(ValueError):
        project("name: n\nseeds: [x]\nodd: 1")


def test_actions(spark):
    df = spark.createDataFrame([("add_field", 0.9), ("add_field", 0.1), ("split_entities", 1.0), ("nonsense", 1.0), ("enqueue_links", 0.0)], "type string, confidence double")
    assert [(r["policy"], r["risk"], r["auto"]) for r in triage(df).collect()] == [("auto_above_threshold", "low", True), ("auto_above_threshold", "low", False), ("batch_review", "high", False), ("always_review", "low", False), ("always_auto", "low", True)]
    assert [r["auto"] for r in triage(df, "cautious").collect()] == [False, False, False, False, True]
    jobs = spark.createDataFrame([("j", 1, "pending"), ("j", 2, "queued"), ("j", 3, "completed")], "job_id string, seq long, status string")
    assert [r["valid"] for r in check_transitions(jobs, JOB_STEPS).orderBy("seq").collect()] == [True, True, False]


def stream_of(spark, rows, shape, path):
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(path)
    return spark.readStream.schema(shape).parquet(path)


def collected(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_rate_limit_and_breaker(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STORE)
    calls = [(i, "k", t, i >= 5) for i, t in enumerate([0, 10, 20, 70, 75, 80, 40_000, 40_001, 40_002])]
    stream = stream_of(spark, calls, "event_id long, key string, at_ms long, ok boolean", str(tmp_path / "in"))
    found = collected(spark, events.rate_limited(stream, "key", 2, 60), "limited", str(tmp_path / "c1"))
    assert [r["admitted"] for r in sorted(found, key=lambda r: r["event_id"])] == [True, True, False, True, True, False, True, True, False]
    found = collected(spark, events.broken_circuits(stream, "key"), "broken", str(tmp_path / "c2"))
    assert [(r["allowed"], r["state"]) for r in sorted(found, key=lambda r: r["event_id"])] == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]


def test_stream_dedup_and_replay(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    stream = stream_of(spark, rows, "event_id long, key string", str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("event_id"))
    found = collected(spark, events.first_seen(stream, "key", "at"), "seen", str(tmp_path / "c"))
    assert sorted(r["key"] for r in found) == ["a", "b"]
    log = spark.createDataFrame([(5, "x", "t"), (6, "y", "t"), (7, "z", "u")], "event_id long, type string, tenant_id string")
    assert [r["type"] for r in events.replay(log, 2, "t").collect()] == ["replay_truncated", "x", "y"]
    assert [r["event_id"] for r in events.replay(log, 5, "t").collect()] == [6]
