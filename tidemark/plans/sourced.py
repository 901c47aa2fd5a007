"""Queries of our own stream sources and sinks, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators.storage import fresh_folder
from tidemark.operators.timeseries import HOUR
from tidemark.plans.inputs import events
from tidemark.plans.streams import _drained, _stream
from tidemark.sources import files, streams
from tidemark.sources.paths import store_of

_E = "(SELECT epoch_us(ts) AS us, value FROM events)"


@query("stream_fixed_rate", f"SELECT n, t0 + n * {HOUR} AS us, CAST(count(e.us) AS BIGINT) AS passed FROM (SELECT min(us) AS t0, max(us) AS t1 FROM {_E}), LATERAL (SELECT unnest(range(1, (t1 - t0) // {HOUR} + 1)) AS n) LEFT JOIN {_E} AS e ON (e.us - t0) // {HOUR} + 1 = n GROUP BY ALL")
def stream_fixed_rate(s, d):
    """Ticks of every hour of the events' time, each with the number of events in the hour before it."""
    streams.register(s)
    rows = events(s, d, "ts").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    t0, t1 = rows.agg(F.min("us"), F.max("us")).first()
    per_hour = rows.groupBy((F.floor((F.col("us") - t0) / HOUR) + 1).alias("hour")).agg(F.count("*").alias("passed"))
    ticks = s.readStream.format("ticks").option("start", t0).option("period", HOUR).option("until", t1).load()
    return _drained(ticks.join(per_hour, F.col("n") == F.col("hour"), "left").select("n", "us", F.coalesce("passed", F.lit(0)).cast("long").alias("passed")), "ticks")


@query("watch_events", "WITH t AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type) AS k FROM events GROUP BY 1) SELECT event_type || '.txt' AS name, 'created' AS event, CAST(n AS BIGINT) AS length FROM t UNION ALL SELECT event_type || '.txt', 'deleted', n FROM t WHERE k = 1 UNION ALL SELECT event_type || '.txt', 'modified', n + 1 FROM t WHERE k = 2 UNION ALL SELECT 'new.txt', 'created', CAST(sum(n) AS BIGINT) FROM t HAVING count(*) > 0")
def watch_events(s, d):
    """A file for each type of event, of one byte an event; then one is deleted, one grows, and one is new. The stream is stopped in between and goes on from its checkpoint."""
    streams.register(s)
    folder, state, out, held = (fresh_folder(s, f"watch-{k}") for k in ("in", "state", "out", "held"))
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)
    sizes = sorted(map(tuple, events(s, d, "event_type").groupBy("event_type").count().collect()))  # a row a type

    def put(name, n):
        with store.open_output_stream(f"{inner}/{name}.txt") as f:
            f.write(b"x" * n)

    def seen():
        found = s.readStream.format("file_events").option("path", folder).option("state", held).load()
        found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "event", "length").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    for name, n in sizes:
        put(name, n)
    seen()
    if sizes:
        store.delete_file(f"{inner}/{sizes[0][0]}.txt")
        for name, n in sizes[1:2]:
            put(name, n + 1)
        put("new", sum(n for _, n in sizes))
    seen()
    return s.read.schema("name string, event string, length long").parquet(out)


@query("stream_write_rotated", "SELECT event_type || ' ' || event_id AS line FROM events")
def stream_write_rotated(s, d):
    """Lines of a stream in files of at most 4096 bytes, read back."""
    streams.register(s)
    out, state = fresh_folder(s, "rotated"), fresh_folder(s, "rotated-state")
    lines = _stream(s, d).select(F.concat_ws(" ", "event_type", F.col("seq").cast("string")).alias("value"))
    lines.writeStream.format("rotated_text").option("path", out).option("limit", 4096).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return files.read_lines(s, out).filter("line <> ''").select("line")
