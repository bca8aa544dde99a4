"""Named queries over stored requests; their SQL steps through each key's rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.plans.registry import query
from tessera.streaming import jobs

STEPS = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)"""


def at_ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


@query(f"""WITH RECURSIVE {STEPS}, g AS (
  SELECT event_id, user_id, n, ms, ms AS granted FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.ms, greatest(e.ms, g.granted + CASE WHEN e.user_id % 5 = 0 THEN 36000000 ELSE 21600000 END)
  FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
SELECT event_id, user_id, granted AS grant_ms, granted - ms AS wait_ms FROM g""")
def domain_spacing(t):
    events = t("events").select("event_id", "user_id", "ts")
    delays = events.where("user_id % 5 = 0").select("user_id", F.lit(36_000_000).alias("delay_ms")).distinct()
    return admission.polite_grants(events, "user_id", at_ms(), "event_id", 21_600_000, delays).drop("at_ms")


@query(f"""WITH RECURSIVE {STEPS}, a AS (
  SELECT event_id, user_id, n, TRUE AS admitted, [ms] AS kept FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ms) ELSE kept END
  FROM (SELECT e.event_id, e.user_id, e.n, e.ms, [x FOR x IN a.kept IF x > e.ms - 86400000] AS kept FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1))
SELECT event_id, user_id, admitted FROM a""")
def admitted_requests(t):
    return admission.admitted_requests(t("events"), "user_id", at_ms(), "event_id", 3, 86_400_000).drop("at_ms")


@query(f"""WITH RECURSIVE {STEPS}, b AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, FALSE AS allowed, 'closed' AS state, 0 AS failed, 0 AS passed, 0::BIGINT AS opened FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, was <> 'open',
    CASE WHEN was = 'open' THEN 'open' WHEN ok THEN CASE WHEN was = 'half_open' AND tried >= 1 THEN 'closed' ELSE was END
      WHEN was = 'half_open' OR failed >= 1 THEN 'open' ELSE 'closed' END,
    CASE WHEN was = 'open' THEN failed WHEN ok OR was = 'half_open' OR failed >= 1 THEN 0 ELSE failed + 1 END,
    CASE WHEN was = 'half_open' AND ok AND tried = 0 THEN 1 ELSE 0 END,
    CASE WHEN was <> 'open' AND NOT ok AND (was = 'half_open' OR failed >= 1) THEN ms ELSE opened END
  FROM (SELECT e.*, e.event_type <> 'error' AS ok, b.failed, b.opened,
      CASE WHEN b.state = 'open' AND e.ms - b.opened >= 43200000 THEN 'half_open' ELSE b.state END AS was,
      CASE WHEN b.state = 'open' AND e.ms - b.opened >= 43200000 THEN 0 ELSE b.passed END AS tried
    FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1))
SELECT event_id, user_id, allowed, state FROM b WHERE n > 0""")
def breaker_states(t):
    return admission.breaker_states(t("events"), "user_id", at_ms(), "event_id", F.col("event_type") != "error", 2, 43_200_000, 2).drop("at_ms")


NOON = 1_705_752_000_000  # a time within the events, in milliseconds


@query(f"""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 <= {NOON}),
q AS (SELECT *, lead(ms, 1, {NOON}) OVER (PARTITION BY user_id ORDER BY ms, event_id) - ms AS pause FROM p),
cut AS (SELECT user_id, max(ms) FILTER (WHERE pause >= 86400000) AS dead FROM q GROUP BY user_id),
held AS (SELECT q.*, row_number() OVER (PARTITION BY q.user_id ORDER BY ms DESC, event_id DESC) AS n FROM q JOIN cut USING (user_id) WHERE dead IS NULL OR ms > dead)
SELECT user_id::VARCHAR AS job_id, event_id, ms AS at_ms FROM held WHERE n <= 5""")
def capped_log(t):
    events = t("events").select(F.col("user_id").cast("string").alias("job_id"), "event_id", at_ms().alias("at_ms"))
    return jobs.log_at(events, NOON, 5, 86_400_000)


@query("""WITH x AS (SELECT o_custkey % 200 AS job, year(o_orderdate) AS v, o_orderkey AS id FROM orders),
n AS (SELECT job, v, list_sort(list(id)) AS ids FROM x GROUP BY ALL)
SELECT job::VARCHAR AS job_id, v::BIGINT AS schema_version, array_to_string(ids[1:12], ',') AS extraction_ids FROM n WHERE len(ids) >= 12""")
def evolution_batches(t):
    extractions = t("orders").select((F.col("o_custkey") % 200).cast("string").alias("job_id"), F.year("o_orderdate").cast("long").alias("schema_version"), F.col("o_orderkey").alias("extraction_id"))
    return jobs.batches_due(extractions, 12).withColumn("extraction_ids", F.array_join("extraction_ids", ","))
