"""Queries of sequences whose steps depend on the step before, worked off in parallel over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import automata, boundaries
from tidemark.operators.timeseries import HOUR
from tidemark.plans.inputs import events
from tidemark.plans.times import timed

_E = "e AS (SELECT event_id AS seq, user_id, event_type, epoch_us(ts) AS us, value, row_number() OVER (ORDER BY ts, event_id) AS k FROM events)"
_FIRSTS = "r AS (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT n.nxt FROM r JOIN n ON n.k = r.k WHERE n.nxt IS NOT NULL)"
_NEXT = "n AS MATERIALIZED (SELECT a.k, {} AS nxt FROM e AS a ASOF LEFT JOIN e AS b ON a.us + {} <= b.us)"
_GROUPS = "SELECT {} sum(CASE WHEN r.k IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY e.k) - 1 AS \"group\" FROM e LEFT JOIN r ON r.k = e.k"

query("debounce_unkeyed", f"WITH RECURSIVE {_E}, {_NEXT.format('b.k', HOUR)}, {_FIRSTS} SELECT seq, us, value FROM e WHERE k IN (SELECT k - 1 FROM r) OR k = (SELECT max(k) FROM e)")(lambda s, d: boundaries.debounce(timed(s, d).select("seq", "us", "value"), HOUR))
query("group_within_unkeyed", f"WITH RECURSIVE {_E}, m AS (SELECT max(k) AS top FROM e), {_NEXT.format('CASE WHEN least(a.k + 20, coalesce(b.k, a.k + 20)) <= (SELECT top FROM m) THEN least(a.k + 20, coalesce(b.k, a.k + 20)) END', HOUR)}, {_FIRSTS} SELECT seq, us, value, CAST(\"group\" AS BIGINT) AS \"group\" FROM ({_GROUPS.format('seq, us, value,')})")(lambda s, d: boundaries.group_within(timed(s, d).select("seq", "us", "value"), 20, HOUR))
query(
    "chunk_min_unkeyed",
    f"WITH RECURSIVE c AS (SELECT epoch_us(ts) // {HOUR} AS chunk, count(*) AS n FROM events GROUP BY 1), e AS (SELECT chunk, n, row_number() OVER (ORDER BY chunk) AS k, CAST(sum(n) OVER (ORDER BY chunk) AS BIGINT) AS us FROM c), n AS MATERIALIZED (SELECT a.k, CASE WHEN b.k < (SELECT max(k) FROM e) THEN b.k + 1 END AS nxt FROM e AS a ASOF LEFT JOIN e AS b ON a.us - a.n + 50 <= b.us), {_FIRSTS} SELECT chunk, n, CAST(\"group\" AS BIGINT) AS \"group\" FROM ({_GROUPS.format('chunk, n,')})",
)(lambda s, d: boundaries.chunk_min(timed(s, d).groupBy(F.floor(F.col("us") / HOUR).alias("chunk")).agg(F.count("*").alias("n")), 50))
_BY_TYPE = f"WITH RECURSIVE e AS (SELECT event_type, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events), n AS MATERIALIZED (SELECT a.event_type, a.k, b.k AS nxt FROM e AS a ASOF LEFT JOIN e AS b ON a.event_type = b.event_type AND a.us + {6 * HOUR} <= b.us), r AS (SELECT DISTINCT event_type, CAST(1 AS BIGINT) AS k FROM e UNION ALL SELECT n.event_type, n.nxt FROM r JOIN n ON n.event_type = r.event_type AND n.k = r.k WHERE n.nxt IS NOT NULL)"
query("group_within_hot_keys", f"{_BY_TYPE} SELECT event_type, seq, us, CAST(sum(CASE WHEN r.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.event_type ORDER BY e.k) - 1 AS BIGINT) AS \"group\" FROM e LEFT JOIN r USING (event_type, k)")(
    lambda s, d: boundaries.group_within(events(s, d, "event_type", "ts").select("seq", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), 1 << 40, 6 * HOUR, key="event_type")
)

#: A click arms, a purchase while armed is a sale and disarms; all else changes nothing.
SALES = automata.Machine(("idle", "armed"), {("idle", "click"): ("armed", None), ("armed", "purchase"): ("idle", "sale")})
#: Counts clicks modulo three and says so at every third.
THIRDS = automata.Machine(("zero", "one", "two"), {("zero", "click"): ("one", None), ("one", "click"): ("two", None), ("two", "click"): ("zero", "third")})
_LAST = "SELECT {k} seq, CASE WHEN last = 'click' THEN 'armed' ELSE 'idle' END AS state, CASE WHEN event_type = 'purchase' AND before = 'click' THEN 'sale' END AS output FROM (SELECT *, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER ({p} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER ({p} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id AS seq, user_id, event_type FROM events))"
query("scan_automaton", _LAST.format(k="", p=""))(lambda s, d: automata.run(events(s, d, "event_type"), SALES, F.col("event_type")).drop("event_type"))
query("scan_automaton_by_user", _LAST.format(k="user_id,", p="PARTITION BY user_id"))(lambda s, d: automata.run(events(s, d, "user_id", "event_type"), SALES, F.col("event_type"), key="user_id").drop("event_type"))
query("scan_automaton_thirds", "SELECT seq, CASE n % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS state, CASE WHEN event_type = 'click' AND n % 3 = 0 THEN 'third' END AS output FROM (SELECT event_id AS seq, event_type, count(*) FILTER (event_type = 'click') OVER (ORDER BY event_id) AS n FROM events)")(lambda s, d: automata.run(events(s, d, "event_type"), THIRDS, F.col("event_type")).drop("event_type"))
