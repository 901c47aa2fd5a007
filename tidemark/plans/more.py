"""Queries of effects, checks whose failing branch is reached, clocks, signals, lists of a key, and array constructors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import arrays
from tidemark.operators import folding, grouping, machines, outcomes, pacing, pairing, scans, selection, timeseries
from tidemark.plans.inputs import events, table
from tidemark.plans.times import late

MINUTE = 60_000_000
HOUR = timeseries.HOUR
E = "(SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, value FROM events)"
STOP = f"(SELECT min(seq) FROM {E} WHERE value >= 95)"


def _rows(name, sql, f, *columns):
    query(name, sql)(lambda s, d: f(events(s, d, *(columns or ("value",)))))


def _failure():
    return F.when(F.col("value") >= 95, F.concat(F.lit("row "), F.col("seq").cast("string")))


def _raises(df, message: str):
    """(failed, said): whether counting df's rows fails, and with the message. The point of the query is the failing branch, so its outcome is asked for at once."""
    try:
        df.agg(F.count("*")).collect()
        got = (False, False)
    except Exception as e:
        got = (True, message in str(e))
    return df.sparkSession.range(1).select(F.lit(got[0]).alias("failed"), F.lit(got[1]).alias("said"))


def _tapped(v) -> None:
    if v is not None and v < -1e9:
        raise ValueError("a value that no event has")


_rows("eval_tap", f"SELECT seq, value FROM {E}", lambda e: outcomes.eval_tap(e, "value", _tapped))
_rows("eval_filter_not", f"SELECT seq, value FROM {E} WHERE NOT value < 50", lambda e: outcomes.eval_filter_not(e, "value", lambda v: v < 50))
_rows("from_either", f"SELECT seq, value FROM {E} WHERE value < 95", lambda e: outcomes.from_either(e.filter("value < 95").withColumn("error", _failure()), "error", "value"))
_rows("on_complete", f"SELECT seq, value, 0 AS part, NULL AS failed FROM {E} WHERE seq < coalesce({STOP}, 1e18) UNION ALL SELECT seq, value, 1, NULL FROM {E} WHERE value < 1 UNION ALL SELECT seq, NULL, 2, 'row ' || seq FROM {E} WHERE seq = {STOP}", lambda e: outcomes.on_complete(e, _failure(), e.filter("value < 1")))
_rows("observe_either", f"SELECT CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS side, count(*) AS n, max(seq) AS last FROM {E} GROUP BY 1", lambda e: (lambda both: both[0].unionByName(both[1]))(outcomes.observe_either(e, F.col("value") < 50, *[lambda x, k=k: x.agg(F.count("*").alias("n"), F.max("seq").alias("last")).filter("n > 0").withColumn("side", F.lit(k)) for k in ("low", "high")])))

_rows("ensure_fails", f"SELECT bool_or(value >= 95 OR value IS NULL) AS failed, bool_or(value >= 95 OR value IS NULL) AS said FROM {E}", lambda e: _raises(outcomes.ensure(e, F.col("value") < 95, "too large"), "too large"))
_rows("rethrow_fails", f"SELECT count(*) > 0 AS failed, count(*) > 0 AS said FROM {E} WHERE value >= 95", lambda e: _raises(outcomes.rethrow(e.withColumn("error", _failure())), "row "))
_rows("limit_fails", f"SELECT count(*) > 100 AS failed, count(*) > 100 AS said FROM {E}", lambda e: _raises(selection.limit(e, 100), "more than 100 rows"))
_rows("timeout_fails", f"SELECT max(us) - min(us) > {24 * HOUR} AS failed, max(us) - min(us) > {24 * HOUR} AS said FROM {E}", lambda e: _raises(pacing.timeout(e, 24 * HOUR), "timed out"), "ts")
_rows("rechunk_randomly_sizes", f"SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(seq) AS lo FROM (SELECT seq, sum(CASE WHEN CAST('0x' || substr(md5('7:' || seq), 1, 8) AS BIGINT) % 64 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS chunk FROM {E}) GROUP BY 1", lambda e: grouping.rechunk_randomly(e, 7, 64).groupBy("chunk").agg(F.count("*").alias("n"), F.min("seq").alias("lo")))

_S = "(SELECT event_id + 1 - 2 * (event_id % 2) AS seq, ts, epoch_us(ts) AS us, value FROM events)"
_RUN = f"(SELECT *, max(us) OVER (ORDER BY seq) AS m FROM {_S})"
for _name, _over in (("attempt_reorder_locally", 30 * MINUTE), ("attempt_reorder_at_once", 0)):
    query(_name, f"SELECT seq, ts, value, release, row_number() OVER (ORDER BY release IS NULL, release, us, seq) - 1 AS pos FROM (SELECT a.*, CASE WHEN b.first IS NOT NULL THEN greatest(a.seq, b.first) END AS release FROM {_S} a LEFT JOIN (SELECT x.seq AS k, min(y.s) AS first FROM {_S} x JOIN (SELECT m, min(seq) AS s FROM {_RUN} GROUP BY m) y ON y.m >= x.us + {_over} GROUP BY 1) b ON b.k = a.seq)" if _over else f"SELECT seq, ts, value, seq AS release, row_number() OVER (ORDER BY seq) - 1 AS pos FROM {_S}")(
        lambda s, d, over=_over: timeseries.attempt_reorder_locally(late(s, d), over)
    )
query("in_time_order", f"SELECT seq, ts, value, row_number() OVER (ORDER BY us, seq) - 1 AS pos FROM {_S}")(lambda s, d: timeseries.in_time_order(late(s, d)))
_rows("timestamped_map", f"SELECT seq, ts, value * 2 + 1 AS value FROM {E}", lambda e: timeseries.map_value(e, lambda v: v * 2 + 1), "ts", "value")
_rows("timestamped_map_time", f"SELECT seq, us // {HOUR} * {HOUR} AS us, value FROM {E}", lambda e: timeseries.map_time(e, lambda us: us - us % HOUR).select("seq", timeseries.micros("ts").alias("us"), "value"), "ts", "value")
query("timestamped_tick", "SELECT CAST(5000000 AS BIGINT) AS us, CAST(NULL AS DOUBLE) AS value")(lambda s, d: timeseries.tick(s, 5_000_000).select(timeseries.micros("ts").alias("us"), "value"))
_rows("timestamped_now", f"SELECT count(*) AS n, CAST(1 AS BIGINT) AS times, true AS later FROM {E}", lambda e: timeseries.now(e).agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times"), (F.min("ts") > F.lit("2020-01-01").cast("timestamp")).alias("later")))

_KEYED = "seq long, us long"
_count = lambda: machines.Stateful(0, lambda n, row: (n + 1, [(n + 1,)]))


def _stamped(s, d):
    return events(s, d, "user_id", "ts", "event_type").select("user_id", "seq", timeseries.micros("ts").alias("us"), "event_type")


query("timestamped_preserve", f"SELECT user_id, seq, us, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS n FROM {E}")(lambda s, d: scans.run(_stamped(s, d), machines.on(_count(), 2), f"user_id long, {_KEYED}, n long", "user_id"))
_SIDED = f"SELECT user_id, seq, us, event_type, CASE WHEN event_type {{op}} 'click' THEN CAST(row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY seq) AS BIGINT) ELSE 0 END AS n FROM {E}"
_numbered = lambda step=1: machines.Stateful(0, lambda n, row: (n + step, [(*row[:3], n + step)]))
_padded = lambda inner: machines.Dimap(inner, after=lambda row: (*row[:3], row[3] if len(row) > 3 else 0))
query("timestamped_left", _SIDED.format(op="="))(lambda s, d: scans.run(_stamped(s, d), _padded(machines.left(_numbered(), lambda row: row[2] == "click")), f"user_id long, {_KEYED}, event_type string, n long", "user_id"))
query("timestamped_right", _SIDED.format(op="<>"))(lambda s, d: scans.run(_stamped(s, d), _padded(machines.right(_numbered(), lambda row: row[2] == "click")), f"user_id long, {_KEYED}, event_type string, n long", "user_id"))

_rows("get_and_updates", f"SELECT seq, value, 0 AS part FROM {E} WHERE seq = (SELECT max(seq) FROM {E} WHERE seq <= 100) UNION ALL SELECT seq, value, 1 FROM {E} WHERE seq > 100", lambda e: pairing.get_and_updates(e, 100))
_rows("compiled_list", f"SELECT user_id, len(list(value)) AS n, md5(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq)) AS seqs FROM {E} GROUP BY user_id", lambda e: folding.compiled_list(e, F.col("seq"), "user_id").select("user_id", F.size("values").cast("long").alias("n"), F.md5(F.array_join(F.transform("values", lambda v: v.cast("string")), ",")).alias("seqs")), "user_id", "value")
_rows("compiled_string", f"SELECT user_id, string_agg(event_type, '' ORDER BY seq) AS text FROM {E} GROUP BY user_id", lambda e: folding.compiled_string(e, F.col("event_type"), "user_id"), "user_id", "event_type")

_V = "(SELECT vec_id, embedding AS a FROM embeddings)"


def _array(name, sql, f):
    query(name, f"SELECT vec_id, {sql} FROM {_V}")(lambda s, d: table(s, d, "embeddings").select("vec_id", *f(F.col("embedding"))))


_N = lambda c, name: F.size(c).cast("long").alias(name)
_array("array_right_ends", "a[-3:] AS taken, CAST(len(a[:-4]) AS BIGINT) AS n, a[len(a) - 3] AS last", lambda a: [arrays.take_right(a, 3).alias("taken"), _N(arrays.drop_right(a, 3), "n"), arrays.last(arrays.drop_right(a, 3)).alias("last")])
_array("array_zip", "CAST(len(a) - 1 AS BIGINT) AS n, a[1] AS l, a[2] AS r, round(list_sum(list_transform(list_zip(a[:-2], a[2:]), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 4) AS total", lambda a: [_N(arrays.zip_pairs(a, arrays.drop(a, 1)), "n"), F.get(arrays.zip_pairs(a, arrays.drop(a, 1)), 0)["left"].alias("l"), F.get(arrays.zip_pairs(a, arrays.drop(a, 1)), 0)["right"].alias("r"), F.round(F.aggregate(arrays.zip_with(a, arrays.drop(a, 1), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x), 4).alias("total")])
_array("array_zip_with_index", "CAST(coalesce(list_sum(list_transform(list_filter(list_zip(a, range(0, len(a))), lambda p: p[1] > 0), lambda p: p[2])), 0) AS BIGINT) AS places", lambda a: [F.aggregate(F.filter(arrays.zip_with_index(a), lambda p: p["value"] > 0), F.lit(0).cast("long"), lambda t, p: t + p["index"]).alias("places")])
_array("array_traverse", "CASE WHEN list_bool_and(list_transform(a, lambda x: x > -2.5)) THEN CAST(len(a) AS BIGINT) END AS n, CASE WHEN list_bool_and(list_transform(a, lambda x: x > -2.5)) THEN CAST(len(list_filter(a, lambda x: x > 1)) AS BIGINT) END AS kept", lambda a: [F.when(arrays.traverse(a, lambda x: F.when(x > -2.5, x)).isNotNull(), F.size(arrays.traverse(a, lambda x: F.when(x > -2.5, x))).cast("long")).alias("n"), F.when(arrays.traverse(a, lambda x: F.when(x > -2.5, x)).isNotNull(), F.size(arrays.traverse_filter(a, lambda x: F.when(x > -2.5, x), lambda x: x > 1)).cast("long")).alias("kept")])
_array("array_collect_while", "CAST(coalesce(list_position(list_transform(a, lambda x: x > 0.5), true) - 1, len(a)) AS BIGINT) AS n", lambda a: [_N(arrays.collect_while(a, lambda x: F.when(~(x > 0.5), x * 2)), "n")])
_array("array_made", "[a[1]] AS one, [a[1], a[1], a[1]] AS three, CASE WHEN a[1] > 0 THEN [a[1]] ELSE [] END AS maybe, len(a) = 0 AS none, [a[1], a[2], a[1]] AS first, CAST(1 AS BIGINT) AS rest", lambda a: [arrays.singleton(F.get(a, 0)).alias("one"), arrays.constant(F.get(a, 0), 3).alias("three"), arrays.from_option(F.when(F.get(a, 0) > 0, F.get(a, 0))).alias("maybe"), arrays.is_empty(a).alias("none"), arrays.first_of_queue(F.array(arrays.take(a, 2), arrays.take(a, 2)), 3)[0].alias("first"), _N(arrays.first_of_queue(F.array(arrays.take(a, 2), arrays.take(a, 2)), 3)[1], "rest")])
