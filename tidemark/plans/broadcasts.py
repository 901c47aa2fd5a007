"""Queries of transport streams: a stream for each region with its nations as programs, put into packets and taken apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import records
from tidemark.plans.inputs import events, table
from tidemark.sources import program_tables as tables
from tidemark.sources import transport

PER_SECTION = 2
_ENTRY = [("program", 2, "uint"), ("pid", 2, "uint")]


def _associations(s, d):
    """Packets of each region's association table, two programs a section; every section is sent twice."""
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("seq"))
    place = F.row_number().over(tables.window("seq", "region")) - 1
    entries = n.withColumn("number", F.floor(place / PER_SECTION)).withColumn("entry", records.encode(_ENTRY, {"program": F.col("seq") + 1, "pid": 0xE000 + 0x100 + F.col("seq")}))
    bodies = records.joined(entries, ["region", "number"], F.col("entry"))
    last = bodies.groupBy("region").agg(F.max("number").alias("last"))
    sections = bodies.join(F.broadcast(last), "region").withColumn("section", tables.make_section(tables.ASSOCIATION, F.col("region"), F.col("data"), F.col("number"), F.col("last"), 3))
    twice = sections.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seq", F.struct("turn", "number")).withColumn("pid", F.lit(0))
    return tables.packetise(twice, "region", "pid", "section")


def _sections(packets):
    return tables.with_section(transport.sections(packets, "region", "n").filter("error is null")).withColumn("region", F.col("stream").cast("int"))


query("program_sections", "SELECT region, version, number, max(number) OVER (PARTITION BY region) AS last, 2 AS times FROM (SELECT DISTINCT n_regionkey AS region, 3 AS version, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2 AS number FROM nation)")(
    lambda s, d: _sections(_associations(s, d)).groupBy("region", "version", "number", "last").agg(F.count("*").alias("times"))
)
query("program_association", "SELECT n_regionkey AS region, n_nationkey + 1 AS program, 256 + n_nationkey AS pid FROM nation")(
    lambda s, d: tables.grouped(_sections(_associations(s, d)), "region").filter("missing = 0").select("region", F.explode(F.flatten(F.transform("bodies", tables.programs))).alias("p")).select("region", "p.*")
)
query("program_association_incomplete", "SELECT n_regionkey AS region, 1 AS missing, true AS none FROM nation GROUP BY 1 HAVING count(*) > 2")(
    lambda s, d: tables.grouped(_sections(_associations(s, d)).filter("number <> 0"), "region").select("region", "missing", F.col("bodies").isNull().alias("none"))
)


def _maps(s, d):
    """A map section for each nation: 40 components, each with a descriptor that names the language; too long for one packet."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("region"))
    parts = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("part", F.concat(records.encode([("type", 1, "uint"), ("pid", 2, "uint"), ("n", 2, "uint"), ("tag", 1, "uint"), ("size", 1, "uint"), ("key", 1, "uint")], {"type": F.col("k") % 5 + 1, "pid": 0xE200 + F.col("k") + F.col("region"), "n": F.lit(0xF006), "tag": F.lit(10), "size": F.lit(4), "key": F.col("region")}), F.lit(b"deu")))
    rest = records.joined(parts, ["region"], F.col("part"), "k")
    body = F.concat(records.encode([("pcr", 2, "uint"), ("n", 2, "uint")], {"pcr": 0xE1FF + F.lit(0), "n": F.lit(0xF000)}), F.col("data"))
    made = rest.withColumn("section", tables.make_section(tables.MAP, F.col("region") + 1, body)).withColumn("pid", F.lit(0x100) + F.col("region")).withColumn("seq", F.lit(0))
    return tables.packetise(made, "region", "pid", "section")


query("program_map", "SELECT n_nationkey + 1 AS program, 511 AS pcr_pid, k % 5 + 1 AS type, 512 + k + n_nationkey AS pid, 10 AS tag, 4 AS n FROM nation, (SELECT unnest(range(0, 40)) AS k)")(
    lambda s, d: tables.with_map(_sections(_maps(s, d))).filter("table = 2").select(F.col("extension").alias("program"), "pcr_pid", F.explode("components").alias("c")).withColumn("d", F.explode(tables.descriptors(F.col("c.descriptors")))).select("program", "pcr_pid", "c.type", "c.pid", "d.tag", F.length("d.data").alias("n"))
)


def _accesses(s, d):
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("seq"))
    made = n.withColumn("d", records.encode([("tag", 1, "uint"), ("n", 1, "uint"), ("system", 2, "uint"), ("pid", 2, "uint"), ("private", 1, "uint")], {"tag": F.when(F.col("seq") % 7 == 0, 10).otherwise(9), "n": F.lit(5), "system": 0x0B00 + F.col("seq"), "pid": 0xE300 + F.col("seq"), "private": F.col("seq")}))
    bodies = records.joined(made, ["region"], F.col("d"))
    return tables.packetise(bodies.withColumn("section", tables.make_section(tables.ACCESS, F.lit(0xFFFF), F.col("data"))).withColumn("pid", F.lit(1)).withColumn("seq", F.lit(0)), "region", "pid", "section")


query("conditional_access", "SELECT n_regionkey AS region, 2816 + n_nationkey AS system, 768 + n_nationkey AS pid, printf('%02X', n_nationkey) AS private FROM nation WHERE n_nationkey % 7 <> 0")(
    lambda s, d: _sections(_accesses(s, d)).select("region", F.explode(tables.access(F.col("body"))).alias("a")).select("region", "a.system", "a.pid", F.hex("a.private").alias("private"))
)


def _stamped(v):
    """33 bits with marker bits, in five bytes; a time stamp begins again after them."""
    v = F.pmod(v, F.lit(tables.STAMP_TURN))
    return records.encode([("a", 1, "uint"), ("b", 2, "uint"), ("c", 2, "uint")], {"a": 0x21 + F.shiftright(v, 30) * 2, "b": (F.shiftright(v, 15) % 32768) * 2 + 1, "c": (v % 32768) * 2 + 1})


def _elementary(s, d):
    e = events(s, d, "user_id", "event_type")
    pts = F.col("seq") * 90_000 + F.col("user_id")
    whole = F.concat(records.encode([("start", 3, "uint"), ("id", 1, "uint"), ("length", 2, "uint"), ("a", 1, "uint"), ("b", 1, "uint"), ("n", 1, "uint")], {"start": F.lit(1), "id": F.lit(0xE0), "length": F.length("event_type") + 8, "a": F.lit(0x80), "b": F.lit(0x80), "n": F.lit(5)}), _stamped(pts), F.col("event_type").cast("binary"))
    return e.select("seq", whole.alias("data")).select("seq", tables.elementary(F.col("data")).alias("p")).select("seq", "p.stream_id", "p.length", "p.scrambling", tables.unwrapped(F.col("p.pts"), F.col("seq") * 90_000, tables.STAMP_TURN).alias("pts"), "p.dts", F.col("p.payload").cast("string").alias("payload"))


query("elementary_packets", "SELECT event_id AS seq, 224 AS stream_id, length(event_type) + 8 AS length, 0 AS scrambling, event_id * 90000 + user_id AS pts, CAST(NULL AS BIGINT) AS dts, event_type AS payload FROM events")(_elementary)


def _clocks(s, d):
    e = events(s, d)
    base, rest = F.pmod(F.col("seq") * 27_000 + 7, F.lit(tables.PCR_TURN // 300)), F.col("seq") % 300
    whole = F.concat(records.encode([("sync", 1, "uint"), ("pid", 2, "uint"), ("c", 1, "uint"), ("n", 1, "uint"), ("flags", 1, "uint"), ("high", 4, "uint"), ("low", 2, "uint")], {"sync": F.lit(0x47), "pid": F.lit(0x1FF), "c": 0x20 + F.col("seq") % 16, "n": F.lit(183), "flags": F.when(F.col("seq") % 4 == 0, 0x50).otherwise(0x10), "high": F.shiftright(base, 1), "low": (base % 2) * 32768 + 0x7E00 + rest}), F.unhex(F.repeat(F.lit("FF"), F.lit(176))))
    return e.select("seq", tables.adaptation(whole).alias("a"), transport.header(whole)["counter"].alias("counter"), F.length(whole).alias("n")).select("seq", "counter", "n", tables.unwrapped(F.col("a.pcr"), F.col("seq") * 27_000 * 300, tables.PCR_TURN).alias("pcr"), "a.random_access", "a.discontinuity")


query("packet_clocks", "SELECT event_id AS seq, event_id % 16 AS counter, 188 AS n, (event_id * 27000 + 7) * 300 + event_id % 300 AS pcr, event_id % 4 = 0 AS random_access, false AS discontinuity FROM events")(_clocks)
