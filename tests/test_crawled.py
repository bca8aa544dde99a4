"""Sources and sinks by name: what is fetched, where a pull goes on, what is sent once."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import crawled
from tessera.sources.sinks import signature


@pytest.fixture(autouse=True)
def named(spark):
    crawled.register(spark)


def test_crawl(spark, tmp_path):
    urls = [f"https://{h}.example.com/{p}" for h in ("a", "b", "c") for p in ("x", "y", "gone")] + ["https://a.example.com/x"]
    read = spark.read.format("crawl").options(urls=json.dumps(urls), fetcher="tests.remote_ends:fetch", seen=str(tmp_path), parts="4").load()
    rows = {r["url"]: r for r in read.collect()}
    assert set(rows) == set(urls) and len(list(tmp_path.iterdir())) == 9
    r = rows["https://b.example.com/gone"]
    assert (r["host"], r["status_code"], r["crawler_type"], r["content_length"]) == ("b.example.com", 404, "browser", len(r["html"])) and r["links"][0]["url"].endswith("/next")
    own = read.where((F.col("host") == "b.example.com") & (F.col("status_code") == 200))
    assert own.count() == 2 and len(list(tmp_path.iterdir())) == 12
    assert read.where(F.col("url").isin(urls[0], urls[4])).count() == 2 and len(list(tmp_path.iterdir())) == 14


def test_remote_pull_goes_on(spark, tmp_path):
    (tmp_path / "latest").write_text("10")
    options = {"endpoint": "tests.remote_ends:Endpoint", "folder": str(tmp_path), "schema": "id long, body string", "per_task": "4"}
    assert spark.read.format("remote").options(**options, since="3").load().count() == 7

    def pull():
        stream = spark.readStream.format("remote").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    pulled = lambda: sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    pull()
    assert pulled() == list(range(1, 11))
    (tmp_path / "latest").write_text("25")
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="down"):
        pull()
    assert pulled() == list(range(1, 11))
    (tmp_path / "broken").unlink()
    for _ in range(3):
        pull()
        assert pulled() == list(range(1, 26))


def test_webhook_sends_each_event_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    path = str(tmp_path / "in")
    spark.range(10, 16).selectExpr("id AS event_id", "'created' AS type").coalesce(1).write.parquet(path)

    def send(checkpoint):
        stream = spark.readStream.schema("event_id long, type string").parquet(path)
        writer = stream.writeStream.format("webhook").options(url=str(box), sender="tests.remote_ends:receive", ledger=f"file://{tmp_path}/ledger", secret="s")
        writer.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    # Three events are sent before the receiver fails; then the batch is repeated.
    with pytest.raises(Exception, match="no answer"):
        send("c")
    assert json.loads((tmp_path / "ledger/batches/0.json").read_text())["state"] == "aborted"
    send("c")
    # A lost checkpoint repeats everything.
    send("other")
    got = [p for p in box.iterdir() if p.name.startswith("got-")]
    assert sorted(p.name.split("-")[1] for p in got) == [str(i) for i in range(10, 16)]
    one = json.loads(got[0].read_text())
    assert one["X-Signature"] == "sha256=" + signature("s", one["body"]) and one["Idempotency-Key"] == str(json.loads(one["body"])["event_id"])
    assert json.loads((tmp_path / "ledger/batches/0.json").read_text()) == {"state": "committed", "sent": 0, "skipped": 6}
