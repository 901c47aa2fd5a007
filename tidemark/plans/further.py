"""Queries of ends that must exist, stateful maps, time-outs between rows, ticks, and further array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import arrays
from tidemark.operators import generators, grouping, outcomes, pairing, scans, selection, timeseries
from tidemark.plans.inputs import events, of_type, table

HOUR = timeseries.HOUR
E = "(SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, value FROM events)"


def _rows(name, sql, f, *columns):
    query(name, sql)(lambda s, d: f(events(s, d, *(columns or ("value",)))))


_rows("last_option", f"SELECT max(seq) AS seq, arg_max(value, seq) AS value, true AS found FROM {E}", selection.last_option)
_rows("last_option_empty", "SELECT CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS value, false AS found", lambda e: selection.last_option(e.filter("value < 0 and value > 1")))
_rows("head_or_error", f"SELECT seq, value FROM {E} WHERE seq = (SELECT min(seq) FROM {E})", lambda e: selection.or_error(selection.head(e), "empty"))
_rows("last_or_error", f"SELECT seq, value FROM {E} WHERE seq = (SELECT max(seq) FROM {E})", lambda e: selection.or_error(selection.last(e), "empty"))
_rows("uncons_n", f"SELECT seq, value, row_number() OVER (ORDER BY seq) <= 100 AS in_head FROM {E}", lambda e: selection.uncons_n(e, 100))
_rows("eval_map_filter", f"SELECT seq, value, value * 2 AS made FROM {E} WHERE value < 30", lambda e: outcomes.eval_map_filter(e, "value", lambda v: v * 2 if v < 30 else None, "double", "made"))
_rows("map_chunks", f"SELECT seq, value + 1 AS value FROM {E}", lambda e: outcomes.map_chunks(e, lambda p: p.assign(value=p["value"] + 1), "seq long, value double"))
_GAP = f"(SELECT min(seq) FROM (SELECT seq, us - lag(us) OVER (ORDER BY seq) AS gap FROM {E}) WHERE gap > {HOUR // 2})"
_rows("timeout_on_pull_to", f"SELECT seq, ts, 0 AS part FROM {E} WHERE seq < coalesce({_GAP}, 1e18) UNION ALL SELECT seq, ts, 1 FROM {E} WHERE value >= 99 AND {_GAP} IS NOT NULL", lambda e: outcomes.timeout_on_pull_to(e, HOUR // 2, e.filter("value >= 99")).drop("value"), "ts", "value")
_rows("scan_chunks", f"SELECT chunk, n, CAST(total AS BIGINT) AS total, CAST(sum(total) OVER (ORDER BY chunk) AS BIGINT) AS state FROM (SELECT (row_number() OVER (ORDER BY seq) - 1) // 64 AS chunk, count(*) AS n, sum(length(event_type)) AS total FROM (SELECT seq, event_type, row_number() OVER (ORDER BY seq) AS k FROM {E}) GROUP BY 1)".replace("(row_number() OVER (ORDER BY seq) - 1) // 64", "(k - 1) // 64"), lambda e: grouping.scan_chunks(grouping.chunk_n(e, 64), "chunk", F.length("event_type").cast("long")), "event_type")
_rows("chunk_all", f"SELECT CAST(0 AS BIGINT) AS chunk, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM {E} HAVING count(*) > 0", lambda e: grouping.chunk_all(e).groupBy("chunk").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")))

_MACHINE = "user_id long, seq long, n long, state long, out long"
_N = f"(SELECT user_id, seq, length(event_type) AS n FROM {E})"


def _lengths(s, d):
    return events(s, d, "user_id", F.length("event_type").cast("long").alias("n"))


query("eval_map_accumulate", f"SELECT user_id, seq, n, CAST(sum(n) OVER w AS BIGINT) AS state, CAST(sum(n) OVER w * n AS BIGINT) AS out FROM {_N} WINDOW w AS (PARTITION BY user_id ORDER BY seq)")(
    lambda s, d: scans.run(_lengths(s, d), scans.Accumulate(0, lambda t, r: (t + r.n, (t + r.n) * r.n), 2), _MACHINE, "user_id")
)
query("eval_scan", f"SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS state FROM (SELECT DISTINCT user_id FROM {_N}) UNION ALL SELECT user_id, row_number() OVER w, CAST(sum(n) OVER w AS BIGINT) FROM {_N} WINDOW w AS (PARTITION BY user_id ORDER BY seq)")(
    lambda s, d: scans.run(_lengths(s, d), scans.Accumulate(0, lambda t, r: (t + r.n, r.n), 2, True), _MACHINE, "user_id").select("user_id", (F.row_number().over(selection.window("seq", "user_id")) - 1).cast("long").alias("k"), "state")
)
query("eval_fold", f"SELECT user_id, CAST(sum(n) AS BIGINT) AS state FROM {_N} GROUP BY user_id")(
    lambda s, d: scans.run(_lengths(s, d), scans.Accumulate(0, lambda t, r: (t + r.n, r.n), 2), _MACHINE, "user_id").groupBy("user_id").agg(F.max_by("state", "seq").alias("state"))
)
query("either", f"SELECT seq, value, CASE event_type WHEN 'click' THEN 'L' ELSE 'R' END AS side FROM {E} WHERE event_type IN ('click', 'purchase')")(lambda s, d: pairing.merge(of_type(s, d, "click", "value"), of_type(s, d, "purchase", "value")))
query("fixed_rate", "SELECT i AS seq, 1000 + (i + 1) * 250 AS us FROM (SELECT unnest(range(0, 1000)) AS i)")(lambda s, d: generators.fixed_rate(s, 1000, 250, 1000))
query("fixed_rate_start_immediately", "SELECT i AS seq, 1000 + i * 250 AS us FROM (SELECT unnest(range(0, 1000)) AS i)")(lambda s, d: generators.fixed_rate(s, 1000, 250, 1000, True))
query("unfold_chunk", "SELECT CAST(row_number() OVER (ORDER BY i, k) - 1 AS BIGINT) AS seq, CAST(k AS BIGINT) AS value FROM (SELECT unnest(range(0, 20)) AS i), LATERAL (SELECT unnest(range(0, i)) AS k)")(lambda s, d: generators.unfold_chunk(s, 0, lambda i: (list(range(i)), i + 1) if i < 20 else None, "long"))
query("unfold_chunk_loop", "SELECT CAST(row_number() OVER (ORDER BY i, k) - 1 AS BIGINT) AS seq, CAST(k AS BIGINT) AS value FROM (SELECT unnest(range(1, 31)) AS i), LATERAL (SELECT unnest(range(0, i)) AS k)")(lambda s, d: generators.unfold_chunk_loop(s, 1, lambda i: (list(range(i)), i + 1 if i < 30 else None), "long"))
query("iterate_eval", "SELECT i AS seq, 3 * i + 5 AS value FROM (SELECT unnest(range(0, 50)) AS i)")(lambda s, d: generators.iterate_eval(s, 5, lambda v: v + 3, "long").filter("seq < 50").limit(50))
query("repeat_eval", "SELECT i AS seq, CAST(42 AS BIGINT) AS value FROM (SELECT unnest(range(0, 1000)) AS i)")(lambda s, d: generators.repeat_eval(s, lambda: 6 * 7, 1000, "long"))
query("evals", "SELECT i AS seq, i * i AS value FROM (SELECT unnest(range(0, 40)) AS i)")(lambda s, d: generators.evals(s, lambda: [i * i for i in range(40)], "long"))
query("from_option", "SELECT CAST(0 AS BIGINT) AS seq, CAST(7 AS BIGINT) AS value")(lambda s, d: generators.from_option(s, 7, "bigint").unionByName(generators.from_option(s, None, "bigint")))
query("unfold_loop", "SELECT i AS seq, i * i AS value FROM (SELECT unnest(range(0, 11)) AS i)")(lambda s, d: generators.unfold_loop(s, 0, lambda i: (i * i, i + 1 if i < 10 else None), "long"))

_V = "(SELECT vec_id, embedding AS a FROM embeddings)"


def _array(name, sql, f):
    query(name, f"SELECT vec_id, {sql} FROM {_V}")(lambda s, d: table(s, d, "embeddings").select("vec_id", *f(F.col("embedding"))))


_array("array_contains", "list_contains(a, a[3]) AS own, list_contains(a, CAST(9 AS FLOAT)) AS other", lambda a: [arrays.contains(a, F.get(a, 2)).alias("own"), arrays.contains(a, F.lit(9).cast("float")).alias("other")])
_array("array_fold_left", "CAST(len(list_filter(a, lambda x: x > 0)) AS BIGINT) AS n", lambda a: [arrays.fold_left(a, F.lit(0).cast("long"), lambda s, x: s + F.when(x > 0, 1).otherwise(0)).alias("n")])
_array("array_flat_map", "CAST(2 * len(a) AS BIGINT) AS n, a[2] AS third", lambda a: [F.size(arrays.flat_map(a, lambda x: F.array(x, x))).cast("long").alias("n"), F.get(arrays.flat_map(a, lambda x: F.array(x, x)), 2).alias("third")])
_array("array_ends", "a[1] AS head, a[len(a)] AS last, CAST(len(list_filter(a, lambda x: x < 0)) AS BIGINT) AS below", lambda a: [F.get(a, 0).alias("head"), arrays.last(a).alias("last"), arrays.count(a, lambda x: x < 0).cast("long").alias("below")])
_array("array_concat", "CAST(2 * len(a) AS BIGINT) AS n, CAST(len(list_filter(a, lambda x: x > 0)) AS BIGINT) AS kept", lambda a: [F.size(arrays.concat(a, a)).cast("long").alias("n"), F.size(arrays.compact_nulls(F.transform(a, lambda x: F.when(x > 0, x)))).cast("long").alias("kept")])
