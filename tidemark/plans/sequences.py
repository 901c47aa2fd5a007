"""Queries of the sequence operators, on events in order of event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import arrays
from tidemark.operators import folding, generators, grouping, pairing, scans, selection
from tidemark.operators.ordered import with_index
from tidemark.plans.inputs import events, of_type, table



def P():
    return F.col("value") < 95


E = "(SELECT event_id AS seq, ts, user_id, event_type, value FROM events)"
STOP = f"(SELECT min(seq) FROM {E} WHERE NOT (value < 95))"


def _selected(name, sql, f, *columns):
    query(name, sql)(lambda s, d: f(events(s, d, *(columns or ("value",)))))


_selected("take_while", f"SELECT seq, value FROM {E} WHERE seq < coalesce({STOP}, 1e18)", lambda e: selection.take_while(e, P()))
_selected("take_through", f"SELECT seq, value FROM {E} WHERE seq <= coalesce({STOP}, 1e18)", lambda e: selection.take_through(e, P()))
_selected("drop_while", f"SELECT seq, value FROM {E} WHERE seq >= {STOP}", lambda e: selection.drop_while(e, P()))
_selected("drop_through", f"SELECT seq, value FROM {E} WHERE seq > {STOP}", lambda e: selection.drop_through(e, P()))
_selected("take_while_by_user", f"SELECT seq, user_id, value FROM (SELECT *, bool_and(value < 95) OVER (PARTITION BY user_id ORDER BY seq) AS ok FROM {E}) WHERE ok", lambda e: selection.take_while(e, P(), key="user_id"), "user_id", "value")
_selected("take_n", f"SELECT seq, value FROM {E} ORDER BY seq LIMIT 25", lambda e: selection.take(e, 25))
_selected("drop_n", f"SELECT seq, value FROM (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM {E}) WHERE r > 25", lambda e: selection.drop(e, 25))
_selected("head", f"SELECT seq, value FROM {E} ORDER BY seq LIMIT 1", selection.head)
_selected("tail", f"SELECT seq, value FROM {E} WHERE seq > (SELECT min(seq) FROM {E})", selection.tail)
_selected("last", f"SELECT seq, value FROM {E} ORDER BY seq DESC LIMIT 1", selection.last)
_selected("last_or", "SELECT CAST(-1 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS value", lambda e: selection.last_or(e.filter("value < -1e9"), {"seq": -1, "value": 0.0}))
_selected("take_right", f"SELECT seq, value FROM {E} ORDER BY seq DESC LIMIT 7", lambda e: selection.take_right(e, 7))
_selected("drop_right", f"SELECT seq, value FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM {E}) WHERE r > 7", lambda e: selection.drop_right(e, 7))
_selected("drop_last_if", f"SELECT seq, value FROM {E} WHERE NOT (seq = (SELECT max(seq) FROM {E}) AND value >= 0)", lambda e: selection.drop_last_if(e, F.col("value") >= 0))
_selected("delete_first", f"SELECT seq, value FROM {E} WHERE seq <> {STOP}", lambda e: selection.delete_first(e, ~P()))
_selected("find_first", f"SELECT seq, value FROM {E} WHERE value >= 95 ORDER BY seq LIMIT 1", lambda e: selection.find(e, ~P()))
_selected("collect_first", f"SELECT seq, value * 2 AS doubled FROM {E} WHERE value >= 95 ORDER BY seq LIMIT 1", lambda e: selection.collect_first(e, F.when(~P(), F.col("value") * 2), "doubled"))
_selected("collect_while", f"SELECT seq, value, value * 2 AS doubled FROM {E} WHERE seq < coalesce({STOP}, 1e18)", lambda e: selection.collect_while(e, F.when(P(), F.col("value") * 2), "doubled"))
_selected("collect", f"SELECT seq, value, value * 2 AS doubled FROM {E} WHERE value < 50", lambda e: selection.collect(e, F.when(F.col("value") < 50, F.col("value") * 2), "doubled"))
_selected("filter", f"SELECT seq, value FROM {E} WHERE value < 95", lambda e: e.filter(P()))
_selected("filter_not", f"SELECT seq, value FROM {E} WHERE NOT coalesce(value < 95, false)", lambda e: selection.filter_not(e, P()))
_selected("map_as", f"SELECT seq, 1 AS one, sqrt(abs(value)) AS root FROM {E}", lambda e: e.select("seq", F.lit(1).alias("one"), F.sqrt(F.abs("value")).alias("root")))
_selected("flat_map", f"SELECT seq, unnest([value, -value]) AS v FROM {E}", lambda e: e.select("seq", F.explode(F.array(F.col("value"), -F.col("value"))).alias("v")))
_selected("limit_checked", f"SELECT seq, value FROM {E}", lambda e: selection.limit(e, 10**15))
_selected("exists_any", f"SELECT coalesce(bool_or(value >= 95), false) AS result FROM {E}", lambda e: selection.exists(e, ~P()))
_selected("forall_all", f"SELECT coalesce(bool_and(value < 95), true) AS result FROM {E}", lambda e: selection.forall(e, P()))
_selected("forall_empty", "SELECT true AS result", lambda e: selection.forall(e.filter("value < -1e9"), P()))
_selected("changes", f"SELECT seq, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY seq) AS p, lag(1) OVER (ORDER BY seq) AS h FROM {E}) WHERE h IS NULL OR p IS DISTINCT FROM event_type", lambda e: selection.changes_by(e, F.col("event_type")), "event_type")
_selected("changes_by_user", f"SELECT seq, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS p, lag(1) OVER (PARTITION BY user_id ORDER BY seq) AS h FROM {E}) WHERE h IS NULL OR p IS DISTINCT FROM event_type", lambda e: selection.changes_by(e, F.col("event_type"), key="user_id"), "user_id", "event_type")
_selected("if_empty_emit", "SELECT CAST(0 AS BIGINT) AS seq, CAST(-1 AS DOUBLE) AS value", lambda e: selection.if_empty_emit(e.filter("value < -1e9"), {"seq": 0, "value": -1.0}))
_selected("intersperse", f"SELECT CASE WHEN k = 0 THEN seq END AS seq, CASE WHEN k = 0 THEN value ELSE 0 END AS value, 2 * i - k AS pos FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM {E}), (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR i > 0", lambda e: selection.intersperse(e, {"value": 0.0}))
_selected("append", f"SELECT seq, value, 0 AS part FROM {E} WHERE value < 50 UNION ALL SELECT seq, value, 1 FROM {E} WHERE value >= 90", lambda e: selection.append(e.filter("value < 50"), e.filter("value >= 90")))
_selected("repeat_n", f"SELECT seq, value, turn FROM {E}, (SELECT unnest([0, 1, 2]) AS turn)", lambda e: selection.repeat_n(e, 3))
_selected("none_terminate", f"SELECT seq, value, true AS defined FROM {E} UNION ALL SELECT max(seq) + 1, NULL, false FROM {E}", selection.none_terminate)
_selected("un_none", f"SELECT seq, v FROM (SELECT seq, CASE WHEN value < 95 THEN value END AS v FROM {E}) WHERE v IS NOT NULL", lambda e: selection.un_none(e.select("seq", F.when(P(), F.col("value")).alias("v")), "v"))
_selected("un_none_terminate", f"SELECT seq, value AS v FROM {E} WHERE seq < coalesce({STOP}, 1e18)", lambda e: selection.un_none_terminate(e.select("seq", F.when(P(), F.col("value")).alias("v")), "v"))

_selected("zip_with_index", f"SELECT seq, value, row_number() OVER (ORDER BY seq) - 1 AS idx FROM {E}", with_index)
_selected("zip_with_index_by_user", f"SELECT seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS idx FROM {E}", lambda e: with_index(e, key="user_id"), "user_id")
_N = "lag(value) OVER w AS previous, lag(true) OVER w IS NOT NULL AS has_previous"
_X = "lead(value) OVER w AS next, lead(true) OVER w IS NOT NULL AS has_next"
_selected("zip_with_next", f"SELECT seq, value, {_X} FROM {E} WINDOW w AS (ORDER BY seq)", lambda e: grouping.zip_with_neighbours(e, "value", back=False))
_selected("zip_with_previous", f"SELECT seq, value, {_N} FROM {E} WINDOW w AS (ORDER BY seq)", lambda e: grouping.zip_with_neighbours(e, "value", ahead=False))
_selected("zip_with_previous_and_next", f"SELECT seq, user_id, value, {_N}, {_X} FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY seq)", lambda e: grouping.zip_with_neighbours(e, "value", key="user_id"), "user_id", "value")
_selected("chunk_n", f"SELECT chunk, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 64 AS chunk FROM {E}) GROUP BY chunk", lambda e: grouping.chunk_n(e, 64).groupBy("chunk").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")))
_selected("chunk_n_strict", f"SELECT chunk, count(*) AS n FROM (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 64 AS chunk FROM {E}) GROUP BY chunk HAVING count(*) = 64", lambda e: grouping.chunk_n(e, 64, partial=False).groupBy("chunk").agg(F.count("*").alias("n")))
_RUNS = f"(SELECT *, sum(b) OVER (ORDER BY seq) - 1 AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY seq) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM {E}))"
_selected("group_adjacent_by", f"SELECT CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(seq) AS lo FROM {_RUNS} GROUP BY run, event_type", lambda e: grouping.group_adjacent_by(e, F.col("event_type")).groupBy("run", "event_type").agg(F.count("*").alias("n"), F.min("seq").alias("lo")), "event_type")
_selected("group_adjacent_by_limit", f"SELECT CAST(run AS BIGINT) AS run, (k - 1) // 2 AS part, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM {_RUNS}) GROUP BY 1, 2", lambda e: grouping.group_adjacent_by_limit(e, F.col("event_type"), 2).groupBy("run", "part").agg(F.count("*").alias("n")), "event_type")


def _sliding_sql(size: int, step: int) -> str:
    alive = f"(w - 1) * {step} + {size} < n" if step < size else f"w * {step} < n"
    rows = f"(SELECT row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM {E})"
    return f"SELECT w AS \"window\", count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM {rows} r, LATERAL (SELECT unnest(range(greatest(0, i // {step} - {size}), i // {step} + 1)) AS w) WHERE i - w * {step} < {size} AND (w = 0 OR {alive}) GROUP BY w"


for _size, _step in ((3, 2), (2, 3)):
    _selected(f"sliding_{_size}_{_step}", _sliding_sql(_size, _step), lambda e, a=_size, b=_step: grouping.sliding(with_index(e, name="i"), a, b).groupBy("window").agg(F.count("*").alias("n"), F.sum("i").alias("places")))
_selected("sliding_whole", f"SELECT count(*) AS n, CAST(3 * (SELECT count(*) FROM {E}) - 6 AS BIGINT) AS members FROM {E} HAVING count(*) > 2", lambda e: grouping.sliding(e, 3).agg(F.count("*").alias("members")).crossJoin(e.agg(F.count("*").alias("n"))).select("n", "members"))
_SPLIT = f"(SELECT seq, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS d, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS g FROM {E})"
_selected("split_on_purchase", f'SELECT CAST(g - d AS BIGINT) AS "group", CAST(sum(1 - d) AS BIGINT) AS n FROM {_SPLIT} GROUP BY 1', lambda e: grouping.split_sizes(e, F.col("event_type") == "purchase"), "event_type")

_selected("fold_sum", f"SELECT round(coalesce(sum(value), 0) + 10, 4) AS result FROM {E}", lambda e: folding.fold(e, F.col("value"), "sum", seed=10).select(F.round("result", 4).alias("result")))
_selected("fold_map_count", f"SELECT count(value) AS result FROM {E}", lambda e: folding.fold(e, F.col("value"), "count"))
_selected("fold1_max", f"SELECT max(value) AS result FROM {E}", lambda e: folding.fold1(e, F.col("value"), "max"))
_selected("reduce_empty", f"SELECT max(value) AS result FROM {E} WHERE value < -1e9 HAVING count(*) > 0", lambda e: folding.fold1(e.filter("value < -1e9"), F.col("value"), "max"))
_selected("compile_count", f"SELECT count(*) AS n FROM {E}", lambda e: e.agg(F.count("*").alias("n")))
_selected("compile_last", f"SELECT arg_max(value, seq) AS value FROM {E}", lambda e: e.agg(F.max_by("value", "seq").alias("value")))
_selected("scan_sum", f"SELECT CAST(0 AS BIGINT) AS pos, CAST(5 AS BIGINT) AS state UNION ALL SELECT row_number() OVER (ORDER BY seq), CAST(5 + sum(user_id) OVER (ORDER BY seq) AS BIGINT) FROM {E}", lambda e: folding.scan(e, F.col("user_id"), seed=5).select("pos", F.col("state").cast("long").alias("state")), "user_id")
_selected("scan1_max", f"SELECT seq, value, max(value) OVER (ORDER BY seq) AS state FROM {E}", lambda e: folding.scan1(e, F.col("value")))
_selected("map_accumulate", f"SELECT seq, user_id, CAST(sum(user_id) OVER (ORDER BY seq) AS BIGINT) AS state FROM {E}", lambda e: folding.zip_with_scan(e, F.col("user_id"), after=True), "user_id")
_selected("zip_with_scan", f"SELECT seq, user_id, CAST(sum(user_id) OVER (ORDER BY seq) - user_id + 3 AS BIGINT) AS state FROM {E}", lambda e: folding.zip_with_scan(e, F.col("user_id"), seed=3), "user_id")
_selected("zip_with_scan1", f"SELECT seq, user_id, count(*) OVER (PARTITION BY user_id ORDER BY seq) AS state FROM {E}", lambda e: folding.zip_with_scan(e, F.lit(1), key="user_id", after=True), "user_id")

_A = "(SELECT event_id AS seq, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_type = 'click')"
_B = "(SELECT event_id AS seq, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_type = 'purchase')"


def _paired(name, sql, f):
    query(name, sql)(lambda s, d: f(of_type(s, d, "click", "value"), of_type(s, d, "purchase", "value")))


_paired("zip", f"SELECT a.i AS pos, a.seq AS lseq, b.seq AS rseq FROM {_A} a JOIN {_B} b USING (i)", lambda a, b: pairing.zip_rows(a, b).select("pos", F.col("l.seq").alias("lseq"), F.col("r.seq").alias("rseq")))
_paired("zip_all", f"SELECT coalesce(a.i, b.i) AS pos, coalesce(a.seq, -1) AS lseq, coalesce(b.seq, -2) AS rseq FROM {_A} a FULL JOIN {_B} b ON a.i = b.i", lambda a, b: pairing.zip_all(a, b).select("pos", F.when(F.col("has_l"), F.col("l.seq")).otherwise(-1).alias("lseq"), F.when(F.col("has_r"), F.col("r.seq")).otherwise(-2).alias("rseq")))
_paired("align", f"SELECT coalesce(a.i, b.i) AS pos, a.i IS NOT NULL AS has_l, b.i IS NOT NULL AS has_r FROM {_A} a FULL JOIN {_B} b ON a.i = b.i", lambda a, b: pairing.zip_all(a, b).select("pos", "has_l", "has_r"))
_paired("zip_left", f"SELECT a.seq, a.value FROM {_A} a JOIN {_B} b USING (i)", lambda a, b: pairing.zip_rows(a, b).select("l.*"))
_paired("zip_with", f"SELECT a.i AS pos, a.value - b.value AS diff FROM {_A} a JOIN {_B} b USING (i)", lambda a, b: pairing.zip_rows(a, b).select("pos", (F.col("l.value") - F.col("r.value")).alias("diff")))
_paired("interleave", f"SELECT seq, value, side, 2 * i + side AS pos FROM (SELECT *, 0 AS side FROM {_A} UNION ALL SELECT *, 1 FROM {_B}) WHERE i < (SELECT least((SELECT count(*) FROM {_A}), (SELECT count(*) FROM {_B})))", pairing.interleave)
_paired("interleave_all", f"SELECT seq, value, side, row_number() OVER (ORDER BY i, side) - 1 AS pos FROM (SELECT *, 0 AS side FROM {_A} UNION ALL SELECT *, 1 FROM {_B})", pairing.interleave_all)
_paired("interleave_ordered", f"SELECT seq, value, side, row_number() OVER (ORDER BY seq, side) - 1 AS pos FROM (SELECT *, 0 AS side FROM {_A} UNION ALL SELECT *, 1 FROM {_B})", lambda a, b: pairing.interleave_ordered(a, b, "seq"))
_paired("merge_tagged", f"SELECT seq, value, 'L' AS side FROM {_A} UNION ALL SELECT seq, value, 'R' FROM {_B}", pairing.merge)
_paired("merge_halt_both", f"SELECT * FROM (SELECT seq, value, 'L' AS side FROM {_A} UNION ALL SELECT seq, value, 'R' FROM {_B}) WHERE seq <= least((SELECT max(seq) FROM {_A}), (SELECT max(seq) FROM {_B}))", pairing.merge_halt)
query("switch_map", "SELECT b.event_id AS seq, b.user_id, max(a.event_id) AS current FROM events b JOIN events a ON a.user_id = b.user_id AND a.event_type = 'click' AND a.event_id < b.event_id WHERE b.event_type = 'purchase' GROUP BY 1, 2")(lambda s, d: pairing.switch_map(of_type(s, d, "click", "user_id"), of_type(s, d, "purchase", "user_id"), key="user_id").select("seq", "user_id", F.col("outer.seq").alias("current")))
_selected("hold_latest", f"SELECT seq, user_id, value, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS held FROM {E}", lambda e: pairing.latest(e, F.when(F.col("value") >= 50, F.col("value")), "held", key="user_id"), "user_id", "value")
_selected("broadcast_through", f"SELECT seq, value, 'low' AS branch FROM {E} WHERE value < 50 UNION ALL SELECT seq, value * 2, 'high' FROM {E} WHERE value >= 50", lambda e: e.filter("value < 50").withColumn("branch", F.lit("low")).unionByName(e.filter("value >= 50").select("seq", (F.col("value") * 2).alias("value"), F.lit("high").alias("branch"))))
query("conflate_by_user", "SELECT user_id, count(*) AS n, max(value) AS top, arg_max(event_type, event_id) AS latest FROM events GROUP BY user_id")(lambda s, d: events(s, d, "user_id", "value", "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.max_by("event_type", "seq").alias("latest")))

query("range_step", "SELECT unnest(range(5, 1000, 7)) AS v")(lambda s, d: generators.range_(s, 5, 1000, 7).select(F.col("id").alias("v")))
query("ranges", "SELECT v AS lo, least(v + 64, 1000) AS hi FROM (SELECT unnest(range(0, 1000, 64)) AS v)")(lambda s, d: generators.ranges(s, 0, 1000, 64))
query("constant_n", "SELECT i AS seq, 7 AS value FROM range(20) t(i)")(lambda s, d: generators.constant(s, 7, 20))
query("emits", "SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS seq, unnest([3, 1, 2]) AS value")(lambda s, d: generators.emits(s, [3, 1, 2], "int"))
query("iterate_powers", "WITH RECURSIVE r(seq, v) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT seq + 1, v * 3 FROM r WHERE v < 100000) SELECT seq, v FROM r")(lambda s, d: generators.iterate(s, "1L", "v * 3", "v < 100000"))
query("unfold_collatz", "WITH RECURSIVE r(seq, value) AS (SELECT CAST(0 AS BIGINT), CAST(27 AS BIGINT) UNION ALL SELECT seq + 1, CASE WHEN value % 2 = 0 THEN value // 2 ELSE 3 * value + 1 END FROM r WHERE value <> 1) SELECT seq, value FROM r")(lambda s, d: generators.unfold(s, 27, lambda v: None if v is None else (v, None if v == 1 else v // 2 if v % 2 == 0 else 3 * v + 1), "long"))

SCANNED = "user_id long, seq long, value double"
_KEPT = """WITH RECURSIVE e AS (SELECT user_id, seq, value, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM (SELECT event_id AS seq, user_id, value FROM events)),
r AS (SELECT user_id, seq, value, k, value AS last, true AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.seq, e.value, e.k, greatest(e.value, r.last), e.value > r.last FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, seq, value FROM r WHERE kept"""
query("filter_with_previous", _KEPT)(lambda s, d: scans.run(events(s, d, "user_id", "value"), scans.FilterWithPrevious(lambda a, b: b > a), SCANNED, "user_id"))
_RESPLIT = """WITH d AS (SELECT lang, doc_id, text, n, CAST(sum(n) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS upto FROM (SELECT lang, doc_id, coalesce(text, '') AS text, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)),
p AS (SELECT lang, generate_subscripts(x, 1) AS i, unnest(x) AS piece, len(x) AS most FROM (SELECT lang, string_split(string_agg(text, '' ORDER BY doc_id), chr(10)) AS x FROM d GROUP BY lang))
SELECT p.lang, d.doc_id AS seq, CAST(i - 1 - (upto - n) AS INTEGER) AS k, piece FROM p JOIN d ON d.lang = p.lang AND i > upto - n AND i <= upto UNION ALL SELECT lang, NULL, 0, piece FROM p WHERE i = most AND piece <> ''"""
query("resplit_words", _RESPLIT)(lambda s, d: grouping.resplit(table(s, d, "documents").select(F.col("doc_id").alias("seq"), "lang", "text"), "\n", key="lang"))

_V = "(SELECT vec_id, embedding AS a FROM embeddings)"


def _array(name, sql, f):
    query(name, f"SELECT vec_id, {sql} FROM {_V}")(lambda s, d: table(s, d, "embeddings").select("vec_id", *f(F.col("embedding"))))


_array("array_take_drop", "CAST(len(a[1:3]) AS INTEGER) AS taken, a[1] AS first, CAST(len(a[4:]) AS INTEGER) AS dropped, a[4] AS fourth", lambda a: [F.size(arrays.take(a, 3)).alias("taken"), F.get(arrays.take(a, 3), 0).alias("first"), F.size(arrays.drop(a, 3)).alias("dropped"), F.get(arrays.drop(a, 3), 0).alias("fourth")])
_array("array_filter_map", "CAST(len(list_filter(a, lambda x: x > 0)) AS INTEGER) AS positive, round(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * 2)), 4) AS doubled", lambda a: [F.size(F.filter(a, lambda x: x > 0)).alias("positive"), F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * 2), 4).alias("doubled")])
_array("array_index_where", "coalesce(CAST(list_position(list_transform(a, lambda x: x > 0), true) AS INTEGER) - 1, -1) AS at", lambda a: [F.coalesce(arrays.index_where(a, lambda x: x > 0), F.lit(-1)).alias("at")])
_array("array_scan", "round(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE))), 5) AS last_state", lambda a: [F.round(F.element_at(arrays.scan_left(a, F.lit(0.0), lambda s, x: s + x.cast("double")), -1), 5).alias("last_state")])
