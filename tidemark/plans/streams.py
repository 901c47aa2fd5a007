"""Queries that run as streams: events arrive as a file stream, everything there is worked off and the sink is read back. Rows wait for the watermark, so SQL says which windows it has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import scans
from tidemark.operators.storage import fresh_folder
from tidemark.operators.timeseries import HOUR
from tidemark.plans.inputs import table
from tidemark.plans.times import _DEBOUNCED, _GROUPED
from tidemark.sources import files
from tidemark.streaming import operators as streaming

E = "(SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, value FROM events)"
MARK = "(SELECT max(epoch_us(ts)) - 600000000 FROM events)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return rows.withColumnRenamed("event_id", "seq").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(made: DataFrame, name: str) -> DataFrame:
    """What a stream puts out until its source is worked off, in a Parquet sink of its own."""
    spark = made.sparkSession
    out, state = fresh_folder(spark, name), fresh_folder(spark, f"{name}-state")
    made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _query(name, sql, f):
    query(name, sql)(lambda s, d: _drained(f(_stream(s, d)), name))


_query("stream_windowed_rate", f"SELECT make_timestamp(h * {HOUR}) AS start, make_timestamp((h + 1) * {HOUR}) AS end, round(sum(value), 4) AS total, count(*) AS n FROM (SELECT us // {HOUR} AS h, value FROM {E}) GROUP BY h HAVING (h + 1) * {HOUR} <= {MARK}", lambda e: streaming.windowed_rate(e, "ts", "1 hour", F.col("value")).withColumn("total", F.round("total", 4)))
_query("stream_windowed_rate_by_user", f"SELECT make_timestamp(h * {HOUR}) AS start, user_id, count(*) AS n FROM (SELECT us // {HOUR} AS h, user_id FROM {E}) GROUP BY h, user_id HAVING (h + 1) * {HOUR} <= {MARK}", lambda e: streaming.windowed_rate(e, "ts", "1 hour", F.col("value"), key="user_id").select("start", "user_id", "n"))
_query("stream_sessions", f"SELECT user_id, make_timestamp(min(us)) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, seq) AS g FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) < {HOUR} THEN 0 ELSE 1 END AS b FROM {E})) GROUP BY user_id, g HAVING max(us) + {HOUR} <= {MARK}", lambda e: streaming.sessions(e, "ts", "1 hour", "user_id").select("user_id", "start", "n"))
_query("stream_distinct_within", f"SELECT DISTINCT user_id, event_type FROM {E}", lambda e: streaming.distinct_within(e, "ts", ["user_id", "event_type"]).select("user_id", "event_type"))
_query("stream_filter_changes", f"SELECT user_id, seq, value FROM {E} WHERE value >= 95", lambda e: e.filter("value >= 95").select("user_id", "seq", "value"))
_TIMED = "user_id long, seq long, us long, value double"
_timed = lambda e: e.select("user_id", "seq", F.unix_micros("ts").alias("us"), "value")
_query("stream_group_within", _GROUPED, lambda e: streaming.group_within(_timed(e), "user_id", 5, 24 * HOUR, f"{_TIMED}, group long"))
_query("stream_debounce", f"SELECT d.* FROM ({_DEBOUNCED}) d WHERE seq <> (SELECT max(seq) FROM {E} e WHERE e.user_id = d.user_id)", lambda e: streaming.debounce(_timed(e), "user_id", 6 * HOUR, _TIMED))
_query("stream_broadcast_through", f"SELECT seq, 'low' AS branch FROM {E} WHERE value < 50 UNION ALL SELECT seq, 'all' FROM {E}", lambda e: streaming.broadcast_through(e, lambda x: x.filter("value < 50").select("seq", F.lit("low").alias("branch")), lambda x: x.select("seq", F.lit("all").alias("branch"))))
_query("stream_running_count", f"SELECT user_id, seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS state FROM {E}", lambda e: scans.run_stream(e.select("user_id", "seq"), scans.Accumulate(0, lambda n, row: (n + 1, None), 1), "user_id long, seq long, state long, out long", "user_id").select("user_id", "seq", "state"))


def _fanned(s, d):
    """Two sinks of one stream. A batch that is tried again writes to the same place, so that nothing is in twice."""
    low, high, state = (fresh_folder(s, f"fan-{k}") for k in ("low", "high", "state"))

    def sink(folder, rule):
        return lambda batch, number: batch.filter(rule).select("seq", "value").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    streaming.fan_out(_stream(s, d).select("seq", "value"), sink(low, "value < 50"), sink(high, "value >= 50")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("seq long, value double").parquet(low).select("seq", "value", F.lit("low").alias("sink")).unionByName(s.read.schema("seq long, value double").parquet(high).select("seq", "value", F.lit("high").alias("sink")))


query("stream_fan_out", f"SELECT seq, value, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS sink FROM {E} WHERE value IS NOT NULL")(_fanned)


def _tailed(s, d):
    table(s, d, "events").select("event_type").write.text(folder := fresh_folder(s, "tail"))
    return _drained(files.tail(s, folder), "tailed").groupBy("value").agg(F.count("*").alias("n"))


query("stream_tail_lines", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")(_tailed)


def _arrived(s, d):
    table(s, d, "events").select("event_type").coalesce(1).write.text(folder := fresh_folder(s, "arrivals"))
    return _drained(files.arrivals(s, folder, "*.txt"), "arrived").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


query("stream_arrivals", "SELECT CAST(1 AS BIGINT) AS n, CAST(sum(length(event_type) + 1) AS BIGINT) AS bytes FROM events")(_arrived)
