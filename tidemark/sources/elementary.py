"""Elementary streams that run over many transport packets, and the program that a packet belongs to while tables change.

A unit is the packets of a (stream, pid) from one that begins a unit up to the next such one; units are numbered by one running count over packets that are sorted by stream, pid and order together, so a stream is spread over tasks like many streams. The table in force at a packet is the last one before it: table entries and packets are sorted together, and a running maximum carries the last entry on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.records import encode, field
from tidemark.operators.ordered import near, running, window
from tidemark.sources.transport import PACKET, SYNC, header


def payload(packet: Column) -> Column:
    """What follows a packet's header and adaptation field; empty where the header says that there is none."""
    control = F.shiftright(field(packet, 3, 1), 4) % 4
    at = F.when(control >= 2, field(packet, 4, 1) + 5).otherwise(4)
    return F.when(control % 2 == 1, packet.substr((at + 1).cast("int"), F.lit(PACKET))).otherwise(F.lit(b""))


def units(packets: DataFrame, stream: str, order: str, packet: str = "packet") -> DataFrame:
    """(stream, pid, order, n_packets, intact, data) of each unit: the order of its first packet, and whether its packets' counters follow one another (also on the packet before it). Packets before a pid's first beginning are no unit. A unit is one value."""
    h = header(F.col(packet))
    rows = packets.select(F.col(stream).alias("__stream"), F.col(order).alias("__order"), h.alias("__h"), payload(F.col(packet)).alias("__p"))
    rows = rows.select("__stream", F.col("__h.pid").alias("__pid"), "__order", F.col("__h.begins").alias("__begins"), F.col("__h.counter").cast("int").alias("__counter"), "__p").filter(F.octet_length("__p") > 0)
    place = ["__stream", "__pid", "__order"]

    def before(w) -> dict[str, Column]:
        last = F.lag(F.struct("__stream", "__pid", "__counter")).over(w)
        own = last.isNull() | ~last["__stream"].eqNullSafe(F.col("__stream")) | ~last["__pid"].eqNullSafe(F.col("__pid"))
        return {"__follows": own | ((last["__counter"] + 1) % 16 == F.col("__counter"))}

    marked = near(rows.drop("__p"), before, 1, 0, place)
    counted = running(marked, F.col("__begins").cast("long"), "__unit", "sum", place).select(F.struct(*place).alias("__at"), "__unit", "__follows")
    joined = rows.withColumn("__o", F.struct(*place)).join(counted, F.col("__o").eqNullSafe(F.col("__at")))
    parts = F.array_sort(F.collect_list(F.struct("__order", F.hex("__p").alias("h"))))
    made = joined.groupBy("__stream", "__pid", "__unit").agg(F.min("__order").alias(order), F.min_by("__begins", "__order").alias("__whole"), F.count("*").alias("n_packets"), F.bool_and("__follows").alias("intact"), F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("data"))
    return made.filter("__whole").select(F.col("__stream").alias(stream), F.col("__pid").alias("pid"), order, "n_packets", "intact", "data")


def carried(df: DataFrame, stream: str, pid: str, data: str, order: str = "seq") -> DataFrame:
    """(stream, pid, n, order, packet): each row's data as a unit in packets of its own; the last one is filled by its adaptation field. n counts a stream's packets of a pid, as the counter does."""
    room = PACKET - 4
    count = F.ceil(F.octet_length(data) / room).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col(data), k * room + 1, F.lit(room)))
    rows = df.select(stream, pid, order, F.posexplode(pieces).alias("__k", "__piece")).withColumn("__o", F.struct(order, "__k"))
    rows = rows.withColumn("n", F.row_number().over(window("__o", [stream, pid])).cast("long") - 1)
    spare = F.lit(room) - F.octet_length("__piece")
    filler = F.when(spare == 0, F.lit(b"")).when(spare == 1, F.lit(b"\0")).otherwise(F.concat(encode([("n", 1, "uint"), ("flags", 1, "uint")], {"n": spare - 1, "flags": F.lit(0)}), F.unhex(F.repeat(F.lit("FF"), F.greatest(spare - 2, F.lit(0))))))
    head = encode([("sync", 1, "uint"), ("pid", 2, "uint"), ("counter", 1, "uint")], {"sync": F.lit(SYNC), "pid": F.col(pid) + F.when(F.col("__k") == 0, 0x4000).otherwise(0), "counter": F.when(spare == 0, 0x10).otherwise(0x30) + F.col("n") % 16})
    return rows.select(stream, pid, "n", order, F.concat(head, filler, F.col("__piece")).alias("packet"))


def changes(maps: DataFrame, stream: str, order: str, program: str = "program", components: str = "components") -> DataFrame:
    """(stream, pid, order, program, type) of what each version of a program's map says anew: its components, and (with no type and no program) those of the version before that it no longer has. components: an array of structs with pid and type; null or empty, where a program ends."""
    w = Window.partitionBy(stream, program).orderBy(order)
    own = F.coalesce(F.transform(components, lambda c: F.struct(c["pid"].cast("int").alias("pid"), c["type"].cast("int").alias("type"))), F.array().cast("array<struct<pid:int,type:int>>"))
    rows = maps.select(stream, order, program, own.alias("__now")).withColumn("__before", F.coalesce(F.lag("__now").over(w), F.array().cast("array<struct<pid:int,type:int>>")))
    gone = F.array_except(F.transform("__before", lambda c: c["pid"]), F.transform("__now", lambda c: c["pid"]))
    said = rows.select(stream, order, F.col(program).cast("long").alias("program"), F.explode("__now").alias("c")).select(stream, F.col("c.pid").alias("pid"), order, "program", F.col("c.type").alias("type"))
    left = rows.select(stream, F.explode(gone).alias("pid"), order, F.lit(None).cast("long").alias("program"), F.lit(None).cast("int").alias("type"))
    return said.unionByName(left).groupBy(stream, "pid", order).agg(F.max("program").alias("program"), F.max_by("type", "program").alias("type"))


def in_force(packets: DataFrame, changed: DataFrame, stream: str, order: str, pid: str = "pid") -> DataFrame:
    """packets with the program and the type that the last change of their pid up to their order gave it, null without one."""
    said = changed.select(F.struct(F.col(stream).alias("s"), F.col("pid").cast("int").alias("p"), F.col(order).alias("o")).alias("__key"), F.lit(0).alias("__packet"), F.struct(F.col(stream).alias("s"), F.col("pid").cast("int").alias("p"), F.col(order).alias("o"), "program", "type").alias("__said"))
    rows = packets.withColumn("__row", F.struct(*packets.columns)).select(F.struct(F.col(stream).alias("s"), F.col(pid).cast("int").alias("p"), F.col(order).alias("o")).alias("__key"), F.lit(1).alias("__packet"), "__row")
    both = running(said.unionByName(rows, allowMissingColumns=True), F.col("__said"), "__last", "max", ["__key", "__packet"]).filter("__packet = 1")
    ours = F.col("__last.s").eqNullSafe(F.col("__key.s")) & F.col("__last.p").eqNullSafe(F.col("__key.p"))
    return both.select("__row.*", F.when(ours, F.col("__last.program")).alias("program"), F.when(ours, F.col("__last.type")).alias("type"))
