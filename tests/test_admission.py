"""Spacing, limits and breakers over history against loops over each key's requests, and against the stream's own state."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.admission import admitted_requests, breaker_states, polite_grants
from tessera.operators.scans import Running, in_ranges, with_running
from tessera.plans.scratch import Scratch
from tessera.streaming.events import Breaker, SlidingLimit


def bursts(seed, keys=4, n=400):
    """(event_id, host, at_ms, ok): bursts, pauses and equal times."""
    rng, rows, at = random.Random(seed), [], defaultdict(int)
    for i in range(n):
        host = rng.choice([None, *"abc"][:keys])
        at[host] += rng.choice([0, 0, 1, 3, 10, 40, 100, 250])
        rows.append((i, host, at[host], rng.random() < 0.6))
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "event_id long, host string, at_ms long, ok boolean").withColumn("key", F.lit("clash"))


def by_host(rows):
    out = defaultdict(list)
    for i, host, at, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        out[host].append((i, at, ok))
    return out


@pytest.mark.parametrize("range_rows", [90])
def test_running_values(spark, range_rows):
    rows = bursts(1)
    ranged = in_ranges(table(spark, rows).drop("key"), Scratch(spark, "t"), ["host"], ["at_ms", "event_id"], "r", range_rows)
    values = {"s": Running("sum", F.col("at_ms")), "m": Running("max", F.col("event_id"), own=False), "n": Running("min", F.col("event_id"), backward=True)}
    got = {r["event_id"]: (r["s"], r["m"], r["n"]) for r in with_running(ranged, ["host"], ["at_ms", "event_id"], values).collect()}
    for own in by_host(rows).values():
        for k, (i, _, _) in enumerate(own):
            assert got[i] == (sum(a for _, a, _ in own[: k + 1]), max((e for e, _, _ in own[:k]), default=None), min(e for e, _, _ in own[k:]))


@pytest.mark.parametrize("range_rows", [80])
def test_polite_grants(spark, range_rows):
    rows = bursts(2)
    delays = spark.createDataFrame([("a", 7), ("b", 300)], "host string, delay_ms long")
    got = {r["event_id"]: (r["grant_ms"], r["wait_ms"]) for r in polite_grants(table(spark, rows), "host", F.col("at_ms"), "event_id", 60, delays, range_rows).collect()}
    want = {}
    for host, own in by_host(rows).items():
        last, delay = None, {"a": 7, "b": 300}.get(host, 60)
        for i, at, _ in own:
            last = at if last is None else max(at, last + delay)
            want[i] = (last, last - at)
    assert got == want
    # Three requests at once wait for each other's grants.
    at_once = [(1, "h", 0, True), (2, "h", 0, True), (3, "h", 0, True)]
    assert sorted(r["wait_ms"] for r in polite_grants(table(spark, at_once), "host", F.col("at_ms"), "event_id").collect()) == [0, 1000, 2000]
    assert polite_grants(table(spark, []), "host", F.col("at_ms"), "event_id").count() == 0


class Held:
    """A value of state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getValueState(self, name, schema):
        return Held()


def streamed(processor, key, own, columns):
    processor.init(Handle())
    frame = pd.DataFrame([dict(zip(columns, r, strict=True)) for r in own])
    return pd.concat(list(processor.handleInputRows((key,), iter([frame]), None)))


@pytest.mark.parametrize(("limit", "window", "range_rows", "walk_rows"), [(3, 60, 1_000_000, 1_000_000), (4, 200, 90, 40), (0, 60, 50, 50), (500, 60, 50, 50)])
def test_admitted_requests(spark, limit, window, range_rows, walk_rows):
    rows = bursts(limit + 3, n=300)
    got = {r["event_id"]: r["admitted"] for r in admitted_requests(table(spark, rows), "host", F.col("at_ms"), "event_id", limit, window, range_rows, walk_rows).collect()}
    want = {}
    for host, own in by_host(rows).items():
        passed = []
        for i, at, _ in own:
            passed = [t for t in passed if t > at - window]
            want[i] = len(passed) < limit
            passed += [at] * want[i]
        if limit:
            told = streamed(SlidingLimit(limit, window), host, own, ["event_id", "at_ms", "ok"])
            assert dict(zip(told["event_id"], told["admitted"], strict=True)) == {i: want[i] for i, _, _ in own}
    assert got == want and (limit in (0, 500) or len(set(want.values())) == 2)


@pytest.mark.parametrize(("failures", "pause", "successes", "range_rows"), [(3, 100, 2, 1_000_000), (1, 40, 1, 120)])
def test_breaker_states(spark, failures, pause, successes, range_rows):
    rows = bursts(failures + 20, n=500) + [(9000, "lone", 5, False), (9001, "good", 5, True)]
    got = {r["event_id"]: (r["allowed"], r["state"]) for r in breaker_states(table(spark, rows), "host", F.col("at_ms"), "event_id", F.col("ok"), failures, pause, successes, range_rows).collect()}
    want = {}
    for host, own in by_host(rows).items():
        told = streamed(Breaker(failures, pause, successes), host, own, ["event_id", "at_ms", "ok"])
        want |= {i: (a, s) for i, a, s in zip(told["event_id"], told["allowed"], told["state"], strict=True)}
    assert got == want and len(set(want.values())) >= 3 - (pause == 0)


def test_odd_requests(spark):
    rows = [(1, None, 5, None), (2, None, None, True), (3, "a", -50, False)]
    assert {r["event_id"] for r in admitted_requests(table(spark, rows), "host", F.col("at_ms"), "event_id", 1, 10).collect()} == {1, 3}
    assert {tuple(r)[1:] for r in breaker_states(table(spark, rows), "host", F.col("at_ms"), "event_id", F.col("ok"), 1).collect()} == {(1, 5, True, "open"), (3, -50, True, "open")}
    for empty in (admitted_requests(table(spark, []), "host", F.col("at_ms"), "event_id", 3), breaker_states(table(spark, []), "host", F.col("at_ms"), "event_id", F.col("ok"))):
        assert empty.count() == 0
