"""Queries of streams whose rows come out when time has passed. SQL takes the rows that the watermark has passed and says what is due by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators.timeseries import HOUR
from tidemark.plans.streams import _drained, _stream
from tidemark.plans.times import _DEBOUNCED, _GROUPED, _U
from tidemark.streaming import timers

MARK = "(SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events)"
_PASSED = _U.replace("FROM events)", f"FROM events WHERE epoch_us(ts) <= {MARK})")
_TIMED = "user_id long, us long, seq long, value double"


def _timed(name, sql, machine, schema=_TIMED):
    def run(s, d):
        rows = _stream(s, d).select("ts", F.unix_micros("ts").alias("us"), "seq", "user_id", "value")
        made = timers.replayed(rows, machine, schema, "user_id")
        with timers.timed_state(s):
            return _drained(made, name)

    query(name, sql)(run)


_timed("stream_debounce_timer", f"SELECT user_id, us, seq, value FROM ({_DEBOUNCED.replace(_U, _PASSED).replace('GROUP BY user_id, span', 'GROUP BY user_id, span HAVING min(us) + ' + str(6 * HOUR) + f' <= {MARK}')})", timers.Debounce(6 * HOUR))
_timed(
    "stream_group_within_timer",
    f"SELECT user_id, us, seq, value, \"group\" FROM (SELECT *, count(*) OVER (PARTITION BY user_id, \"group\") AS n, min(us) OVER (PARTITION BY user_id, \"group\") AS begun FROM ({_GROUPED.replace(_U, _PASSED)})) WHERE n = 5 OR begun + {24 * HOUR} <= {MARK}",
    timers.GroupWithin(5, 24 * HOUR),
    f"{_TIMED}, group long",
)
_timed("stream_timeout", f"SELECT user_id, us, seq, value, us + {12 * HOUR} AS at FROM (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS following FROM {_PASSED}) WHERE coalesce(following, {MARK}) >= us + {12 * HOUR}", timers.Timeout(12 * HOUR), f"{_TIMED}, at long")
