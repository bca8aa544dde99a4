"""Events of jobs as they come in: a capped log that expires, replay with a tail behind it, and batches due for evolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.scans import RANGE_ROWS, Running, in_ranges, with_running
from tessera.plans.scratch import Scratch
from tessera.streaming.events import replay

LOG = "job_id string, size long, oldest_id long, newest_id long, event_ids array<long>, expired boolean"
BATCHES = "job_id string, schema_version long, extraction_ids array<long>"


class CappedLog(StatefulProcessor):
    """Each job's last `cap` events, dropped as a whole once `expire_ms` of event time have gone by since the last one.

    A list holds the events, a value the time of the last, and a timer of event time, set anew by each write, drops both.
    """

    def __init__(self, cap: int, expire_ms: int) -> None:
        self.cap, self.expire_ms = cap, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event_id long, at_ms long")
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        held = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        for event, at in zip(new["event_id"].tolist(), new["at_ms"].tolist(), strict=True):
            # What a pause ends is gone, also where both its ends come in one batch.
            if held and at >= held[-1][1] + self.expire_ms:
                held = []
            held = [*held, (event, at)][-self.cap :]
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[0] + self.expire_ms)
        self.events.put(held)
        self.last.update((held[-1][1],))
        self.handle.registerTimer(held[-1][1] + self.expire_ms)
        yield self.row(key, [e for e, _ in held], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.last.clear()
        yield self.row(key, [], True)

    @staticmethod
    def row(key, ids: list[int], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "size": [len(ids)], "oldest_id": pd.array([min(ids, default=None)], dtype="Int64"), "newest_id": pd.array([max(ids, default=None)], dtype="Int64"), "event_ids": [ids], "expired": [expired]})

    def close(self) -> None:
        pass


def capped_log(stream: DataFrame, cap: int = 500, expire_ms: int = 300_000, late: str = "10 seconds") -> DataFrame:
    """The log of each job that a batch of the stream (job_id, event_id, at timestamp) touches, and a row for each that expires."""
    rows = stream.withWatermark("at", late).select("job_id", "event_id", F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("job_id").transformWithStateInPandas(CappedLog(cap, expire_ms), LOG, "update", "eventTime")


def log_at(events: DataFrame, now_ms: int, cap: int = 500, expire_ms: int = 300_000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The same log from history: events (job_id, event_id, at_ms) that it holds at a time.

    A job's log begins behind its last pause of expire_ms; it is empty if the last event lies that far back. The pause behind
    each event, and how many events follow it, are running values, so a job may have any number of events.
    """
    scratch = Scratch(events.sparkSession, "log")
    own = events.where(F.col("at_ms") <= now_ms).select("job_id", "event_id", "at_ms")
    order = ["at_ms", "event_id"]
    ranged = in_ranges(own, scratch, ["job_id"], order, "events", range_rows)
    nexts = scratch.keep(with_running(ranged, ["job_id"], order, {"next": Running("min", F.col("at_ms"), own=False, backward=True)}), "nexts")
    pause = F.coalesce("next", F.lit(now_ms)) - F.col("at_ms")
    told = with_running(nexts.withColumn("pause", pause), ["job_id"], order, {"most": Running("max", F.col("pause"), backward=True), "n": Running("sum", F.lit(1), backward=True)})
    return told.where((F.col("most") < expire_ms) & (F.col("n") <= cap)).select("job_id", "event_id", "at_ms")


def follow(log: DataFrame, stream: DataFrame, after: int | None, tenant: str, out: str, available_now: bool = True) -> StreamingQuery:
    """A tenant's events to Parquet in `out`: first those behind `after` that the log holds, then the stream's.

    The replayed rows are written once and stay the hand-over point: the tail leaves out exactly those, by their ids, whatever
    the stream repeats of the log and in whatever order ids come in. So no event is lost or doubled, and a restart goes on
    with the same hand-over and the stream's own checkpoint. The log is capped, so what the tail is compared with is small.
    """
    spark = log.sparkSession
    path = f"{out}/replay"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        replay(log, after, tenant).write.mode("overwrite").parquet(path)
    replayed = spark.read.parquet(path)
    own = stream.where(F.col("tenant_id") == tenant)
    if after is not None:
        own = own.where(F.col("event_id") > after)
    known = replayed.where(F.col("type") != "replay_truncated").select("event_id").distinct()
    tail = own.join(known, "event_id", "left_anti").select(stream.columns)
    writer = tail.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/tail")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class DueBatches(StatefulProcessor):
    """Tells once for each job and schema version that `size` extractions are in, with their ids.

    A map from version to the ids so far; a version that has been told keeps an empty list, so later extractions of it, a
    repeated batch or a restart do not tell it again.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "schema_version long", "ids array<long>, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["schema_version", "extraction_id"])
        due = []
        for version, own in new.groupby("schema_version"):
            version = int(version)
            ids, told = self.waiting.getValue((version,)) if self.waiting.containsKey((version,)) else ([], False)
            if told:
                continue
            ids = list(dict.fromkeys([*ids, *own["extraction_id"].tolist()]))
            told = len(ids) >= self.size
            if told:
                due.append((key[0], version, ids[: self.size]))
            self.waiting.updateValue((version,), ([] if told else ids, told))
        yield pd.DataFrame(due, columns=["job_id", "schema_version", "extraction_ids"])

    def close(self) -> None:
        pass


def due_batches(stream: DataFrame, size: int) -> DataFrame:
    """job_id, schema_version and extraction_ids of each batch of extractions (job_id, schema_version, extraction_id) due."""
    rows = stream.select("job_id", "schema_version", "extraction_id")
    return rows.groupBy("job_id").transformWithStateInPandas(DueBatches(size), BATCHES, "append", "none")


def batches_due(extractions: DataFrame, size: int) -> DataFrame:
    """The same from history: the first `size` extractions, by id, of each job and version that has so many."""
    by = Window.partitionBy("job_id", "schema_version").orderBy("extraction_id")
    first = extractions.select("job_id", "schema_version", "extraction_id").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= size)
    due = first.groupBy("job_id", "schema_version").agg(F.array_sort(F.collect_list("extraction_id")).alias("extraction_ids"))
    return due.where(F.size("extraction_ids") == size)
