"""Queries of failures, pacing and pauses, on events in order of event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import arrays
from tidemark.operators import folding, grouping, outcomes, pacing, pairing, scans, selection
from tidemark.plans.inputs import events, of_type, table

MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE
E = "(SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, value FROM events)"
STOP = f"(SELECT min(seq) FROM {E} WHERE value >= 95)"


def TOO_LARGE():
    return F.when(F.col("value") >= 95, F.lit("too large"))


def _rows(name, sql, f, *columns):
    query(name, sql)(lambda s, d: f(events(s, d, *(columns or ("value",)))))


_rows("attempt", f"SELECT seq, value, CASE WHEN value >= 95 THEN 'too large' END AS error, CASE WHEN NOT value >= 95 THEN value * 2 END AS result FROM {E} WHERE seq <= coalesce({STOP}, 1e18)", lambda e: outcomes.attempt(e, F.col("value") * 2, TOO_LARGE()))
_rows("ensure", f"SELECT seq, value FROM {E}", lambda e: outcomes.ensure(e, F.col("seq") >= 0, "negative"))
_rows("rethrow_none", f"SELECT seq, value FROM {E} WHERE NOT coalesce(value >= 95, false)", lambda e: outcomes.rethrow(e.withColumn("error", TOO_LARGE()).filter("error is null")))
_rows("mask", f"SELECT seq, value FROM {E} WHERE seq < coalesce({STOP}, 1e18)", lambda e: outcomes.mask(e, TOO_LARGE()))
_rows("handle_error_with", f"SELECT seq, value, 0 AS part FROM {E} WHERE seq < coalesce({STOP}, 1e18) UNION ALL SELECT seq, value, 1 FROM {E} WHERE value < 1 AND {STOP} IS NOT NULL", lambda e: outcomes.handle_error_with(e, TOO_LARGE(), e.filter("value < 1")))
_rows("eval_map", f"SELECT seq, value, value * 2 + 1 AS made FROM {E}", lambda e: outcomes.eval_map(e, "value", lambda v: v * 2 + 1, "double", "made"))
_rows("eval_filter", f"SELECT seq, value FROM {E} WHERE value < 50", lambda e: outcomes.eval_filter(e, "value", lambda v: v < 50))
_rows("compile_only", f"SELECT max(seq) AS top FROM {E}", lambda e: outcomes.only_or_error(e.agg(F.max("seq").alias("top"))))

_rows("metered", f"SELECT seq, row_number() OVER (ORDER BY seq) * 1000000 AS emit_us FROM {E}", lambda e: pacing.metered(e.select("seq"), 1_000_000))
_rows("metered_start_immediately", f"SELECT seq, (row_number() OVER (ORDER BY seq) - 1) * 1000000 AS emit_us FROM {E}", lambda e: pacing.metered(e.select("seq"), 1_000_000, immediately=True))
_rows("delay_by", f"SELECT seq, us + {DAY} AS us FROM {E}", lambda e: pacing.delay_by(e, DAY).select("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "ts")
_rows("keep_alive", f"SELECT seq, us, false AS beat FROM {E} UNION ALL SELECT seq, us + k * {5 * MINUTE}, true FROM (SELECT seq, us, lead(us) OVER (ORDER BY seq) AS nx FROM {E}) g, LATERAL (SELECT unnest(range(1, (nx - us - 1) // {5 * MINUTE} + 1)) AS k)", lambda e: pacing.keep_alive(e, 5 * MINUTE), "ts")
_rows("interrupt_after", f"SELECT seq, value FROM {E} WHERE us < (SELECT min(us) FROM {E}) + {5 * DAY}", lambda e: pacing.interrupt_after(e, 5 * DAY).select("seq", "value"), "ts", "value")
_rows("timeout_kept", f"SELECT seq, value FROM {E}", lambda e: pacing.timeout(e, 4000 * DAY).select("seq", "value"), "ts", "value")
query("interrupt_when", f"SELECT seq, value FROM {E} WHERE event_type = 'click' AND seq < coalesce((SELECT min(seq) FROM {E} WHERE event_type = 'purchase' AND value >= 60), 1e18)")(
    lambda s, d: pacing.interrupt_when(of_type(s, d, "click", "value"), of_type(s, d, "purchase", "value"), F.col("value") >= 60)
)
_PAUSED = "coalesce(last_value(CASE event_type WHEN 'click' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION_ ORDER BY seq ROWS UNBOUNDED PRECEDING), false)"
_PAUSE = f"SELECT seq, user_id, paused, CASE WHEN paused THEN nx ELSE seq END AS release FROM (SELECT seq, user_id, event_type, {_PAUSED} AS paused, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION_ ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM {E}) WHERE event_type NOT IN ('click', 'purchase')"


def _pause(key):
    def run(s, d):
        e = events(s, d, "user_id", "event_type")
        control = e.filter("event_type in ('click', 'purchase')").withColumn("flag", F.col("event_type") == "click")
        return pacing.pause_when(e.filter("event_type not in ('click', 'purchase')").drop("event_type"), control, "flag", key=key)

    return run


query("pause_when", _PAUSE.replace("PARTITION_", ""))(_pause(None))
query("pause_when_by_user", _PAUSE.replace("PARTITION_", "PARTITION BY user_id"))(_pause("user_id"))
_HELD = f"(SELECT seq, value, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM {E})"
_FIFTY = lambda: F.when(F.col("value") >= 50, F.col("value"))
_rows("hold", f"SELECT seq, value, coalesce(held, -1) AS held FROM {_HELD}", lambda e: pacing.hold(e, _FIFTY(), -1.0))
_rows("hold_option", f"SELECT seq, value, held FROM {_HELD}", lambda e: pairing.latest(e, _FIFTY(), "held"))
_rows("hold1", f"SELECT seq, value, held FROM {_HELD} WHERE held IS NOT NULL", lambda e: pacing.hold1(e, _FIFTY()))

_LR = "SELECT * FROM (SELECT seq, value, 'L' AS side FROM {E} WHERE event_type = 'click' UNION ALL SELECT seq, value, 'R' FROM {E} WHERE event_type = 'purchase') WHERE seq <= (SELECT max(seq) FROM {E} WHERE event_type = '{T}')"


def _paired(name, sql, f):
    query(name, sql)(lambda s, d: f(of_type(s, d, "click", "value"), of_type(s, d, "purchase", "value")))


_paired("merge_halt_l", _LR.format(E=E, T="click"), lambda a, b: pairing.merge_halt(a, b, halt="L"))
_paired("merge_halt_r", _LR.format(E=E, T="purchase"), lambda a, b: pairing.merge_halt(a, b, halt="R"))
_I = "(SELECT seq, value, row_number() OVER (ORDER BY seq) - 1 AS i FROM {E} WHERE event_type = '{T}')"
_A, _B = _I.format(E=E, T="click"), _I.format(E=E, T="purchase")
_paired("zip_right", f"SELECT b.seq, b.value FROM {_A} a JOIN {_B} b USING (i)", pairing.zip_right)
_paired("zip_all_with", f"SELECT coalesce(a.i, b.i) AS pos, coalesce(a.value, 0) + coalesce(b.value, 0) AS total FROM {_A} a FULL JOIN {_B} b ON a.i = b.i", lambda a, b: pairing.zip_all(a, b).select("pos", (F.coalesce("l.value", F.lit(0)) + F.coalesce("r.value", F.lit(0))).alias("total")))
_paired("switch_map_global", f"SELECT seq, value, (SELECT max(a.seq) FROM {_A} a WHERE a.seq < b.seq) AS current FROM {_B} b WHERE seq > (SELECT min(seq) FROM {_A})", lambda a, b: pairing.switch_map(a, b).select("seq", "value", F.col("outer.seq").alias("current")))
_paired("par_join", f"SELECT seq, value, event_type AS source FROM {E} WHERE event_type IN ('click', 'purchase')", lambda a, b: pairing.par_join({"click": a, "purchase": b}))

_rows("chunk_limit", f"SELECT us // {DAY} AS day, (k - 1) // 7 AS part, count(*) AS n FROM (SELECT us, row_number() OVER (PARTITION BY us // {DAY} ORDER BY seq) AS k FROM {E}) GROUP BY 1, 2", lambda e: grouping.chunk_limit(e.withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY)), "day", 7).groupBy("day", "part").agg(F.count("*").alias("n")), "ts")
_rows("buffer_by", f"SELECT CAST(block AS BIGINT) AS block, count(*) AS n, min(seq) AS lo FROM (SELECT seq, sum(b) OVER (ORDER BY seq) AS block FROM (SELECT seq, CASE WHEN lag(value < 50) OVER (ORDER BY seq) AND NOT value < 50 THEN 1 ELSE 0 END AS b FROM {E})) GROUP BY 1", lambda e: grouping.buffer_by(e, F.col("value") < 50).groupBy("block").agg(F.count("*").alias("n"), F.min("seq").alias("lo")))
_rows("rechunk_randomly", f"SELECT seq, value FROM {E}", lambda e: grouping.rechunk_randomly(e, 7, 64).drop("chunk"))


_CHUNK_MIN = f"""WITH RECURSIVE e AS (SELECT user_id, us // {DAY} AS chunk, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY us // {DAY}) AS k FROM {E} GROUP BY 1, 2),
r AS (SELECT user_id, k, chunk, n, n AS held, CAST(0 AS BIGINT) AS g FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.chunk, e.n, CASE WHEN r.held >= 10 THEN e.n ELSE r.held + e.n END, CASE WHEN r.held >= 10 THEN r.g + 1 ELSE r.g END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, chunk, n, g AS "group" FROM r"""


@query("chunk_min", _CHUNK_MIN)
def chunk_min(s, d):
    days = events(s, d, "user_id", "ts").groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY).alias("chunk")).agg(F.count("*").alias("n"))
    return scans.run(days, scans.ChunkMin(10), "user_id long, chunk long, n long, group long", "user_id", "chunk")


_rows("drop_last", f"SELECT seq, value FROM {E} WHERE seq < (SELECT max(seq) FROM {E})", selection.drop_last)
_rows("cons", f"SELECT seq, value FROM {E} UNION ALL SELECT min(seq) - 1, -1 FROM {E}", lambda e: selection.cons(e, {"value": -1.0}))
_rows("scan_map", f"SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS state UNION ALL SELECT row_number() OVER (ORDER BY seq), CAST(sum(length(event_type)) OVER (ORDER BY seq) AS BIGINT) FROM {E}", lambda e: folding.scan(e, F.length("event_type").cast("long"), seed=0).withColumn("state", F.col("state").cast("long")), "event_type")
_rows("fold_monoid_any", f"SELECT coalesce(bool_or(value > 99), false) AS result FROM {E}", lambda e: folding.fold(e, F.col("value") > 99, "any"))
_rows("reduce_semigroup_min", f"SELECT min(value) AS result FROM {E}", lambda e: folding.fold1(e, F.col("value"), "min"))

_V = "(SELECT vec_id, embedding AS a FROM embeddings)"


def _array(name, sql, f):
    query(name, f"SELECT vec_id, {sql} FROM {_V}")(lambda s, d: table(s, d, "embeddings").select("vec_id", *f(F.col("embedding"))))


_array("array_split_at", "len(a[1:5]) AS lo, len(a[6:]) AS hi, a[6] AS pivot", lambda a: [F.size(arrays.split_at(a, 5)[0]).cast("long").alias("lo"), F.size(arrays.split_at(a, 5)[1]).cast("long").alias("hi"), F.get(arrays.split_at(a, 5)[1], 0).alias("pivot")])
_array("array_starts_with", "a[1] = a[2] AS twice, true AS own", lambda a: [arrays.starts_with(arrays.drop(a, 1), arrays.take(a, 1)).alias("twice"), arrays.starts_with(a, arrays.take(a, 3)).alias("own")])
_array("array_map_filter", "len(list_filter(a, lambda x: x > 0)) AS n", lambda a: [F.size(arrays.map_filter(a, lambda x: F.when(x > 0, x * 2))).cast("long").alias("n")])
_array("array_map_accumulate", "len(a) AS n, round(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE))), 5) AS last", lambda a: [F.size(arrays.map_accumulate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))).cast("long").alias("n"), F.round(F.element_at(arrays.map_accumulate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), -1), 5).alias("last")])
_array("array_scan_left_carry", "round(CAST(a[1] AS DOUBLE), 5) AS second_state, round(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE))), 5) AS carry", lambda a: [F.round(F.get(arrays.scan_left_carry(a, F.lit(0.0), lambda s, x: s + x.cast("double"))["states"], 1), 5).alias("second_state"), F.round(arrays.scan_left_carry(a, F.lit(0.0), lambda s, x: s + x.cast("double"))["carry"], 5).alias("carry")])
