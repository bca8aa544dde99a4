"""Streams of job events, requests and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "event_id long, type string, job_id string, tenant_id string, timestamp timestamp, data string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, shape: str = EVENTS) -> DataFrame:
    """Events as files come in."""
    return spark.readStream.schema(shape).parquet(path)


def replay(log: DataFrame, after: int | None, tenant: str) -> DataFrame:
    """A tenant's events behind the last id seen; a first row of type replay_truncated if that id is older than the log."""
    own = log.where(F.col("tenant_id") == tenant)
    if after is None:
        return own
    low = own.agg(F.min("event_id").alias("low"))
    cut = low.where(F.col("low") > after + 1).select(
        F.lit(after).alias("event_id"), F.lit("replay_truncated").alias("type"), *[F.lit(None).cast(t).alias(n) for n, t in own.dtypes if n not in ("event_id", "type")]
    )
    return cut.select(own.columns).unionByName(own.where(F.col("event_id") > after))


def latest_events(log: DataFrame, cap: int = 500) -> DataFrame:
    """The last `cap` events of the log."""
    return log.orderBy(F.desc("event_id")).limit(cap)


def first_seen(stream: DataFrame, key: str, time_col: str, within: str = "24 hours") -> DataFrame:
    """The first event of each key; the state of a key goes once the watermark is that far beyond it."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, key: str, time_col: str, late: str = "2 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Events of each key in sliding windows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size, slide), key).agg(F.count("*").alias("n"))


class SlidingLimit(StatefulProcessor):
    """Admits an event if fewer than `limit` admitted ones lie in the `window_ms` before it; rejected ones leave no trace.

    A key's state is the times of its admitted events, at most `limit` of them.
    """

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", T.StructType([T.StructField("at", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        kept = list(self.times.get()[0]) if self.times.exists() else []
        out = []
        for event, at in zip(events["event_id"], events["at_ms"], strict=True):
            kept = [t for t in kept if t > at - self.window_ms]
            admitted = len(kept) < self.limit
            if admitted:
                kept.append(int(at))
            out.append((key[0], event, admitted))
        self.times.update((kept,))
        yield pd.DataFrame(out, columns=["key", "event_id", "admitted"])

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """A circuit breaker for each key: opens after so many failures in a row, lets one try pass after a pause, closes after so many successes."""

    def __init__(self, failures: int = 5, pause_ms: int = 30_000, successes: int = 2) -> None:
        self.failures, self.pause_ms, self.successes = failures, pause_ms, successes

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("state", T.StringType()), ("failed", T.IntegerType()), ("passed", T.IntegerType()), ("opened", T.LongType())]
        self.held = handle.getValueState("breaker", T.StructType([T.StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        state, failed, passed, opened = self.held.get() if self.held.exists() else ("closed", 0, 0, 0)
        out = []
        for event, at, ok in zip(calls["event_id"], calls["at_ms"], calls["ok"], strict=True):
            if state == "open" and at - opened >= self.pause_ms:
                state, passed = "half_open", 0
            allowed = state != "open"
            if allowed and ok:
                failed, passed = 0, passed + 1
                if state == "half_open" and passed >= self.successes:
                    state = "closed"
            elif allowed:
                failed += 1
                if state == "half_open" or failed >= self.failures:
                    state, opened, failed = "open", int(at), 0
            out.append((key[0], event, allowed, state))
        self.held.update((state, failed, passed, opened))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "state"])

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, limit: int, window_ms: int = 60_000) -> DataFrame:
    """key, event_id and admitted for a stream with event_id and at_ms."""
    rows = stream.select(F.col(key).cast("string").alias("key"), "event_id", "at_ms")
    return rows.groupBy("key").transformWithStateInPandas(SlidingLimit(limit, window_ms), "key string, event_id long, admitted boolean", "append", "none")


def broken_circuits(stream: DataFrame, key: str, **options) -> DataFrame:
    """key, event_id, allowed and state for a stream of calls with event_id, at_ms and ok."""
    rows = stream.select(F.col(key).cast("string").alias("key"), "event_id", "at_ms", "ok")
    return rows.groupBy("key").transformWithStateInPandas(Breaker(**options), "key string, event_id long, allowed boolean, state string", "append", "none")


def on_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs work on each micro-batch, such as an evolution of schemas once enough records are in."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
