"""Requests let through over time, worked out over stored history: polite spacing, sliding limits and circuit breakers.

The same rules run on streams in `tessera.streaming.events`. Here a key (a host, a tenant, a model) may hold any share of the
rows: running values go by ranges of rows, and only overload is walked row by row, in ranges of bounded size.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scans import RANGE_ROWS, Running, in_ranges, rank_of, same, with_running
from tessera.plans.scratch import Scratch


def numbered(rows: DataFrame, key: str, at: Column, order: str, scratch: Scratch, range_rows: int, **more: Column) -> DataFrame:
    """key, at (milliseconds), the order column, more columns and idx, each row's number in its key from 0 on."""
    slim = rows.select(F.col(key).alias("key"), at.cast("long").alias("at"), F.col(order).alias("id"), *[c.alias(n) for n, c in more.items()])
    ranged = in_ranges(slim.where("at IS NOT NULL"), scratch, ["key"], ["at", "id"], "ranged", range_rows)
    idx = with_running(ranged, ["key"], ["at", "id"], {"idx": Running("sum", F.lit(1))})
    return scratch.keep(idx.withColumn("idx", F.col("idx") - 1), "numbered")


def polite_grants(requests: DataFrame, key: str, at: Column, order: str, default_ms: int = 1000, delays: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, order column, at_ms, grant_ms and wait_ms of requests (their order column tells them apart).

    A request is granted at once if its host's last grant lies its delay or more back, else when it does: grant(i) =
    max(at(i), grant(i - 1) + delay(i)). With D the running sum of delays that is D(i) + max over j <= i of at(j) - D(j), a
    running maximum, so no request waits for the one before to be worked out. delays (key, delay_ms) overrides the delay of
    single hosts, as their robots.txt asks for it.

    Null key: a host of its own. Null time: no row in the result. Equal times: by the order column. Empty: empty.
    """
    scratch = Scratch(requests.sparkSession, "grants")
    slim = requests.select(F.col(key).alias("key"), at.cast("long").alias("at"), F.col(order).alias("id")).where("at IS NOT NULL")
    if delays is not None:
        told = delays.groupBy(F.col(key).alias("of")).agg(F.max("delay_ms").cast("long").alias("delay"))
        slim = slim.join(told, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "at", "id", F.coalesce("delay", F.lit(default_ms)).cast("long").alias("delay"))
    else:
        slim = slim.withColumn("delay", F.lit(default_ms).cast("long"))
    order_by = ["at", "id"]
    ranged = in_ranges(slim, scratch, ["key"], order_by, "ranged", range_rows)
    summed = scratch.keep(with_running(ranged, ["key"], order_by, {"sum": Running("sum", F.col("delay"))}), "summed")
    found = with_running(summed, ["key"], order_by, {"most": Running("max", F.col("at") - F.col("sum"))})
    grant = F.col("sum") + F.col("most")
    return found.select(F.col("key").alias(key), F.col("id").alias(order), F.col("at").alias("at_ms"), grant.alias("grant_ms"), (grant - F.col("at")).alias("wait_ms"))


def walk_overload(limit: int, window_ms: int):
    """For applyInArrow over (key, episode): rows (at, id, known) to whether each that is not known yet was admitted.

    From one admitted row to the next the walk jumps over all rejected ones: a row is admitted if it lies behind the last
    admitted one and a window or more after the limit-th last.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("id", "ascending")])
        times, taken, i = rows.column("at").to_pylist(), [], 0
        while i < len(times):
            taken.append(i)
            i += 1
            if len(taken) >= limit:
                i = max(i, bisect_left(times, times[taken[-limit]] + window_ms))
        admitted = [False] * len(times)
        for i in taken:
            admitted[i] = True
        out = rows.select(["key", "episode", "at", "id"]).append_column("admitted", pa.array(admitted))
        return out.filter(pc.invert(rows.column("known")))

    return run


def admitted_requests(requests: DataFrame, key: str, at: Column, order: str, limit: int, window_ms: int = 60_000, range_rows: int = RANGE_ROWS, walk_rows: int = RANGE_ROWS) -> DataFrame:
    """key, order column, at_ms and admitted: a request passes if fewer than `limit` of its key passed in the window before.

    A rejected request leaves no trace, so counting requests is not enough. But where a window holds no more requests than the
    limit, all of them pass. Those stretches are found from running counts. What is left are episodes of overload, each
    from the first request beyond the limit until a window has gone by without one; the requests a window before it all
    passed. Episodes are walked on their own; of longer ones, walk_rows at a time, each part from what the one before admitted.

    limit 0 admits nothing. Null key: a key of its own. Null time: no row in the result. Equal times: by the order column,
    which has to tell requests apart.
    """
    scratch = Scratch(requests.sparkSession, "admission")
    rows = numbered(requests, key, at, order, scratch, range_rows)
    out = [F.col("key").alias(key), F.col("id").alias(order), F.col("at").alias("at_ms"), "admitted"]
    if limit < 1:
        return rows.withColumn("admitted", F.lit(False)).select(*out)
    # Requests that a window before t's end has lost: those at t - window or earlier.
    probes = rows.select("key", (F.col("at") - window_ms + 1).alias("at"), "id", "idx")
    gone = rank_of(rows, probes, scratch, ["key"], "at", "gone", range_rows)
    over = gone.select("key", (F.col("at") + window_ms - 1).alias("at"), "id", (F.col("idx") + 1 - F.col("rank") > limit).alias("over"))
    ranged = in_ranges(over, scratch, ["key"], ["at", "id"], "over", range_rows)
    last = Running("max", F.when(F.col("over"), F.col("at")))
    told = scratch.keep(with_running(ranged, ["key"], ["at", "id"], {"last": last, "before": Running("max", last.expr, own=False)}), "told")
    busy = F.coalesce(F.col("last") > F.col("at") - window_ms, F.lit(False))
    starts = F.col("over") & F.coalesce(F.col("before") <= F.col("at") - 2 * window_ms, F.lit(True))
    marked = told.withColumns({"busy": busy, "starts": starts})
    values = {"episode": Running("sum", F.col("starts").cast("long")), "next": Running("min", F.when(F.col("over"), F.col("at")), own=False, backward=True)}
    placed = with_running(marked, ["key"], ["at", "id"], values).select("key", "at", "id", "busy", "last", "episode", "next")
    placed = scratch.keep(placed, "placed")

    # Those that pass without question a window before a request beyond the limit are walked with its episode.
    new = F.coalesce(F.col("last") <= F.col("next") - 2 * window_ms, F.lit(True)).cast("long")
    calm = placed.where(~F.col("busy") & (F.col("next") < F.col("at") + window_ms)).select("key", (F.col("episode") + new).alias("episode"), "at", "id", F.lit(True).alias("known"))
    waiting = placed.where("busy").select("key", "episode", "at", "id", F.lit(False).alias("known")).union(calm)
    ranged = in_ranges(waiting, scratch, ["key", "episode"], ["at", "id"], "waiting", range_rows)
    counted = with_running(ranged, ["key", "episode"], ["at", "id"], {"n": Running("sum", F.lit(1))})
    steps = scratch.keep(counted.select("key", "episode", "at", "id", "known", F.floor((F.col("n") - 1) / walk_rows).cast("int").alias("step")), "steps")
    n_steps = (steps.agg(F.max("step")).first()[0] or 0) + 1
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.select("key", "episode", "at", "id").schema) + ", admitted boolean"
    walked, before = [], None
    for step in range(n_steps):
        mine = steps.where(F.col("step") == step).drop("step")
        if before is not None:
            # The admitted rows of a window before this part; no more of them than the limit.
            begins = mine.groupBy("key", "episode").agg(F.min("at").alias("begin"))
            recent = before.join(begins, same(before, begins, ["key", "episode"])).where(F.col("at") > F.col("begin") - window_ms)
            before = scratch.keep(recent.select(before["key"], before["episode"], "at", "id", F.lit(True).alias("known")), f"before-{step}")
            mine = mine.unionByName(before)
        passed = scratch.keep(mine.groupBy("key", "episode").applyInArrow(walk_overload(limit, window_ms), shape), f"walked-{step}")
        walked.append(passed)
        before = passed.where("admitted").select("key", "episode", "at", "id").union(mine.where("known").select("key", "episode", "at", "id"))
    result = placed.where(~F.col("busy")).select("key", "at", "id", F.lit(True).alias("admitted"))
    for passed in walked:
        result = result.union(passed.select("key", "at", "id", "admitted"))
    return result.select(*out)


def breaker_states(calls: DataFrame, key: str, at: Column, order: str, ok: Column, failures: int = 5, pause_ms: int = 30_000, successes: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, order column, at_ms, allowed and state (after the call) of calls through a circuit breaker for each key.

    The breaker opens after `failures` failed calls in a row, rejects calls for pause_ms, then lets calls pass half open: a
    failure opens it again, `successes` in a row close it. Where it opens next depends only on where it last opened, so each
    failed call points to the opening that would follow if the breaker opened there: calls behind the pause are found by a
    sorted search, runs of failures and successes from running values. The openings that happen are what the first one
    reaches; pointers of doubled length find them in a number of rounds that is the logarithm of theirs.

    A null ok counts as a failure. Null key: a key of its own. Null time: no row in the result. Equal times: by the order
    column, which has to tell calls apart.
    """
    scratch = Scratch(calls.sparkSession, "breaker")
    rows = numbered(calls, key, at, order, scratch, range_rows, ok=F.coalesce(ok, F.lit(False)))
    place = F.col("idx")
    values = {"good": Running("max", F.when(F.col("ok"), place)), "bad": Running("min", F.when(~F.col("ok"), place), backward=True)}
    ranged = in_ranges(rows, scratch, ["key"], ["idx"], "runs", range_rows)
    told = with_running(ranged, ["key"], ["idx"], values)
    # A run of failures counts from behind the last success; `bad` is the next failure, this call's own place if it failed.
    full = F.when(~F.col("ok") & (place - F.coalesce("good", F.lit(-1)) == failures), place)
    told = scratch.keep(told.withColumn("full", full), "told")
    told = scratch.keep(with_running(told, ["key"], ["idx"], {"trip": Running("min", F.col("full"), backward=True)}), "tripped")
    # Pointers: from an opening at j to the first call behind the pause, and on to the failure or the close that follows.
    failed = told.where(~F.col("ok"))
    after = rank_of(rows, failed.select("key", (F.col("at") + pause_ms).alias("at"), F.col("idx").alias("open")), scratch, ["key"], "at", "after", range_rows)
    # Of calls at the time of the opening itself only those behind it count.
    tries = after.select(F.col("key").alias("k"), "open", F.greatest(F.col("rank"), F.col("open") + 1).alias("tried"))
    met = tries.join(told.select("key", "idx", "bad"), F.col("k").eqNullSafe(F.col("key")) & (F.col("tried") == F.col("idx")), "left").select("k", "open", "tried", "bad")
    closing = F.col("tried") + successes - 1
    fails = F.coalesce(F.col("bad") <= closing, F.lit(False))
    met = met.withColumn("close", F.when(~fails, closing))
    later = told.select(F.col("key").alias("kk"), (F.col("idx") - 1).alias("from"), F.col("trip").alias("next_trip"))
    linked = met.join(later, F.col("k").eqNullSafe(F.col("kk")) & (F.col("close") == F.col("from")), "left")
    pointers = scratch.keep(linked.select("k", "open", "tried", F.when(fails, F.col("bad")).otherwise(F.col("next_trip")).alias("next"), "close"), "pointers")

    reached = scratch.keep(told.groupBy("key").agg(F.min("full").alias("open")).where("open IS NOT NULL").select(F.col("key").alias("k"), "open"), "reached-0")
    jumps, n, round_ = pointers.where("next IS NOT NULL").select("k", "open", "next"), reached.count(), 0
    while True:
        to = jumps.select(F.col("k").alias("k2"), F.col("open").alias("o2"), "next")
        found = reached.join(to, F.col("k").eqNullSafe(F.col("k2")) & (F.col("open") == F.col("o2"))).select("k", F.col("next").alias("open"))
        round_ += 1
        reached = scratch.keep(reached.union(found).distinct(), f"reached-{round_}")
        if (now := reached.count()) == n:
            break
        n = now
        double = jumps.join(to.withColumnRenamed("next", "beyond"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("next") == F.col("o2")))
        jumps = scratch.keep(double.select("k", "open", F.col("beyond").alias("next")), f"jumps-{round_}")
    happened = pointers.join(reached.withColumnRenamed("k", "rk").withColumnRenamed("open", "ro"), F.col("k").eqNullSafe(F.col("rk")) & (F.col("open") == F.col("ro")), "left_semi")

    # Each call's state follows from the last opening before or at it.
    events = happened.select(F.col("k").alias("key"), F.col("open").alias("idx"), F.struct("open", "tried", "close").alias("opening"))
    marked = rows.join(events.withColumnRenamed("key", "ek").withColumnRenamed("idx", "ei"), F.col("key").eqNullSafe(F.col("ek")) & (F.col("idx") == F.col("ei")), "left").drop("ek", "ei")
    ranged = in_ranges(marked, scratch, ["key"], ["idx"], "marked", range_rows)
    seen = with_running(ranged, ["key"], ["idx"], {"last": Running("max", F.col("opening"))})
    opening = F.col("last")
    rejected = opening.isNotNull() & (place > opening["open"]) & (place < opening["tried"])
    state = (
        F.when(opening.isNull() | F.coalesce(place >= opening["close"], F.lit(False)), "closed")
        .when((place == opening["open"]) | rejected, "open")
        .otherwise("half_open")
    )
    return seen.select(F.col("key").alias(key), F.col("id").alias(order), F.col("at").alias("at_ms"), (~F.coalesce(rejected, F.lit(False))).alias("allowed"), state.alias("state"))
