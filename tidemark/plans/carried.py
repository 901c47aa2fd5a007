"""Queries of elementary streams over several packets and of program maps in several versions, made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import records
from tidemark.plans.inputs import events
from tidemark.sources import elementary, program_tables


def _packets(s, d):
    """Each event as a unit of a stream (of five) and a pid (of three): a start code, a stamp, and its type many times."""
    e = events(s, d, "user_id", "event_type").select("seq", (F.col("user_id") % 5).cast("int").alias("stream"), (256 + F.col("seq") % 3).cast("int").alias("pid"), F.repeat("event_type", (F.col("seq") % 60 + 1).cast("int")).cast("binary").alias("said"))
    pts = F.col("seq")
    stamp = {"a": F.shiftright(pts, 30) * 2 + 0x21, "b": F.shiftright(pts, 22) % 256, "c": (F.shiftright(pts, 15) % 128) * 2 + 1, "d": F.shiftright(pts, 7) % 256, "e": pts % 128 * 2 + 1}
    layout = [("start", 3, "uint"), ("id", 1, "uint"), ("length", 2, "uint"), ("flags", 2, "uint"), ("n", 1, "uint")]
    head = records.encode(layout, {"start": F.lit(1), "id": F.lit(0xE0), "length": F.lit(0), "flags": F.lit(0x8080), "n": F.lit(5)})
    data = F.concat(head, records.encode([(k, 1, "uint") for k in "abcde"], stamp), F.col("said"))
    return elementary.carried(e.withColumn("data", data), "stream", "pid", "data")


_E = "(SELECT event_id AS seq, CAST(user_id % 5 AS INTEGER) AS stream, CAST(256 + event_id % 3 AS INTEGER) AS pid, repeat(event_type, CAST(event_id % 60 + 1 AS BIGINT)) AS said FROM events)"
query("elementary_units", f"SELECT stream, pid, seq, CAST(ceil((length(said) + 14) / 184.0) AS BIGINT) AS n_packets, true AS intact, seq AS pts, md5(said) AS said FROM {_E}")(
    lambda s, d: elementary.units(_packets(s, d).withColumn("at", F.struct("seq", "n")), "stream", "at").withColumn("p", program_tables.elementary(F.col("data"))).select("stream", "pid", F.col("at.seq").alias("seq"), "n_packets", "intact", "p.pts", F.md5("p.payload").alias("said"))
)
#: Without every event's second packet, units of three packets and more have a gap, and the one after a unit of two follows on none.
query("elementary_units_with_gaps", f"SELECT stream, pid, seq, NOT (n > 2 OR coalesce(before, 1) = 2) AS intact FROM (SELECT *, lag(n) OVER (PARTITION BY stream, pid ORDER BY seq) AS before FROM (SELECT *, ceil((length(said) + 14) / 184.0) AS n FROM {_E}))")(
    lambda s, d: elementary.units(_without_second(_packets(s, d)).withColumn("at", F.struct("seq", "n")), "stream", "at").select("stream", "pid", F.col("at.seq").alias("seq"), "intact")
)


def _without_second(packets):
    from pyspark.sql import Window

    return packets.withColumn("k", F.row_number().over(Window.partitionBy("stream", "pid", "seq").orderBy("n"))).filter("k <> 2").drop("k")


_M = "(SELECT event_id AS seq, user_id % 5 AS stream, event_type, 256 + event_id % 4 AS pid FROM events)"
query("program_in_force", f"SELECT e.seq, CAST(e.stream AS INTEGER) AS stream, CAST(e.pid AS INTEGER) AS pid, CASE WHEN m.pid = e.pid THEN 1 END AS program, CASE WHEN m.pid = e.pid THEN CAST(m.seq % 7 AS INTEGER) END AS type FROM {_M} AS e ASOF LEFT JOIN (SELECT * FROM {_M} WHERE event_type = 'purchase') AS m ON m.stream = e.stream AND m.seq <= e.seq")(
    lambda s, d: elementary.in_force(
        _pids(s, d).drop("event_type"), elementary.changes(_pids(s, d).filter("event_type = 'purchase'").select("stream", "seq", F.lit(1).alias("program"), F.array(F.struct("pid", (F.col("seq") % 7).alias("type"))).alias("components")), "stream", "seq"), "stream", "seq"
    ).withColumn("program", F.col("program").cast("int"))
)


def _pids(s, d):
    """Packets that a purchase maps anew: a program of one component, whose pid is that of the purchase."""
    return events(s, d, "user_id", "event_type").select("seq", (F.col("user_id") % 5).cast("int").alias("stream"), (256 + F.col("seq") % 4).cast("int").alias("pid"), "event_type")
