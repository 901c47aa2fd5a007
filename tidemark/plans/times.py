"""Queries of the event-time operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import boundaries, timeseries
from tidemark.plans.inputs import events, table

HOUR = timeseries.HOUR
_L = "(SELECT event_id + 1 - 2 * (event_id % 2) AS seq, ts, epoch_us(ts) AS us, value FROM events)"
_B = f"(SELECT *, (max(epoch_us(ts)) OVER (ORDER BY event_id) - (SELECT arg_min(epoch_us(ts), event_id) FROM events)) // {HOUR} AS b FROM events)"
_RATE = f"""SELECT g.b AS bucket, make_timestamp((SELECT arg_min(epoch_us(ts), event_id) FROM events) + (g.b + 1) * {HOUR}) AS ts, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total
FROM (SELECT unnest(range(0, (SELECT max(b) + 1 FROM {_B}))) AS b) g LEFT JOIN (SELECT b, count(*) AS n, sum(value) AS total FROM {_B} GROUP BY b) s USING (b)"""


def late(s, d):
    """Neighbours swapped in pairs: some rows come late."""
    swapped = F.col("event_id") + 1 - 2 * (F.col("event_id") % 2)
    return table(s, d, "events").select(swapped.alias("seq"), "ts", "value")


@query("rate_hourly", _RATE)
def rate_hourly(s, d):
    return timeseries.rate(events(s, d, "ts", "value"), HOUR, F.col("value")).withColumn("total", F.round("total", 4))


@query("rate_per_minute", _RATE.replace(str(HOUR), "60000000"))
def rate_per_minute(s, d):
    return timeseries.rate(events(s, d, "ts", "value"), 60_000_000, F.col("value")).withColumn("total", F.round("total", 4))


@query("with_rate", f"SELECT b AS bucket, 'R' AS side, event_id AS seq, ts, round(value, 4) AS v FROM {_B} UNION ALL SELECT bucket, 'L', NULL, ts, total FROM ({_RATE})")
def with_rate(s, d):
    return timeseries.with_rate(events(s, d, "ts", "value"), HOUR, F.col("value")).withColumn("v", F.round("v", 4))


_M = f"(SELECT *, max(us) OVER (ORDER BY seq) AS m FROM {_L})"
query("increasing", f"SELECT seq, ts, value FROM {_M} WHERE us >= m")(lambda s, d: timeseries.increasing(late(s, d)))
query("increasing_either", f"SELECT seq, ts, value, us < m AS late FROM {_M}")(lambda s, d: timeseries.increasing_either(late(s, d)))
query("reorder_locally", f"SELECT seq, ts, value, us < m - 60000000 AS late FROM {_M}")(lambda s, d: timeseries.reorder_locally(late(s, d), 60_000_000))
query("interpolate_ticks", f"""SELECT ts, false AS is_tick, event_id AS seq, value FROM events UNION ALL
SELECT make_timestamp(t0 + n * {HOUR}), true, NULL, NULL FROM (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events), LATERAL (SELECT unnest(range(1, (t1 - t0) // {HOUR} + 1)) AS n)""")(lambda s, d: timeseries.interpolate_ticks(events(s, d, "ts", "value"), HOUR, "value"))
query("drain_left", f"SELECT ts, event_id AS seq, value, 'R' AS side FROM events WHERE event_type <> 'click'")(lambda s, d: timeseries.drain(events(s, d, "ts", "value", "event_type").withColumn("side", F.when(F.col("event_type") == "click", "L").otherwise("R")), "L").drop("event_type"))
query("lift_ticks", f"SELECT count(*) FILTER (is_tick) AS ticks, round(sum(v), 3) AS total FROM (SELECT false AS is_tick, value * 2 AS v FROM events UNION ALL SELECT true, NULL FROM (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events), LATERAL (SELECT unnest(range(1, (t1 - t0) // {HOUR} + 1)) AS n))")(
    lambda s, d: timeseries.lift(timeseries.interpolate_ticks(events(s, d, "ts", "value"), HOUR, "value"), "value", lambda v: v * 2).agg(F.count_if("is_tick").alias("ticks"), F.round(F.sum("value"), 3).alias("total"))
)
query("throttle", "SELECT event_id AS seq, ts, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 / 2.0 AS emit_after FROM events")(lambda s, d: timeseries.throttle(events(s, d, "ts"), 2.0))


def timed(s, d):
    return events(s, d, "user_id", "ts", "value").select("seq", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


_U = "(SELECT user_id, event_id AS seq, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"
_DEBOUNCED = f"""WITH RECURSIVE e AS (SELECT * FROM {_U}), r AS (SELECT user_id, k, us AS begun, 1 AS span FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, CASE WHEN e.us >= r.begun + {6 * HOUR} THEN e.us ELSE r.begun END, CASE WHEN e.us >= r.begun + {6 * HOUR} THEN r.span + 1 ELSE r.span END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, max(seq) AS seq, arg_max(us, seq) AS us, arg_max(value, seq) AS value FROM r JOIN e USING (user_id, k) GROUP BY user_id, span"""
_GROUPED = f"""WITH RECURSIVE e AS (SELECT * FROM {_U}), r AS (SELECT user_id, k, us AS begun, 1 AS n, CAST(0 AS BIGINT) AS g FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, CASE WHEN r.n >= 5 OR e.us >= r.begun + {24 * HOUR} THEN e.us ELSE r.begun END, CASE WHEN r.n >= 5 OR e.us >= r.begun + {24 * HOUR} THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 5 OR e.us >= r.begun + {24 * HOUR} THEN r.g + 1 ELSE r.g END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, seq, us, value, g AS "group" FROM r JOIN e USING (user_id, k)"""
query("debounce_replay", _DEBOUNCED)(lambda s, d: boundaries.debounce(timed(s, d), 6 * HOUR, key="user_id"))
query("group_within_replay", _GROUPED)(lambda s, d: boundaries.group_within(timed(s, d), 5, 24 * HOUR, key="user_id"))
