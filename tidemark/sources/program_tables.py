"""Program tables, elementary packets and adaptation fields of transport streams, as column expressions over the packets and sections of transport.

Offsets and field sizes are those of the public standard (ISO/IEC 13818-1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import crc
from tidemark.functions.records import bit, encode, field, frames
from tidemark.operators.ordered import window
from tidemark.sources.transport import PACKET, SYNC

# Table ids, and the tag of a conditional access descriptor.
ASSOCIATION, ACCESS, MAP, ACCESS_TAG = 0, 1, 2, 9


def with_section(df: DataFrame, section: str = "section") -> DataFrame:
    """Adds the fields of sections in the long form: table, extension, version, current, number, last and body (without the checksum)."""
    d = F.col(section)
    length = field(d, 1, 2) % 4096
    return df.withColumns({"table": field(d, 0, 1), "extension": field(d, 3, 2), "version": F.shiftright(field(d, 5, 1), 1) % 32, "current": bit(d, 5, 7), "number": field(d, 6, 1), "last": field(d, 7, 1), "body": F.substring(d, F.lit(9), (length - 9).cast("int"))})


def programs(body: Column) -> Column:
    """(program, pid) entries of an association section."""
    n = F.floor(F.length(body) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(field(body, k * 4, 2).alias("program"), (field(body, k * 4 + 2, 2) % 8192).alias("pid")))


def descriptors(data: Column) -> Column:
    """(tag, data) of descriptors in a row."""
    return F.transform(frames(data, 2, 1, 1, whole=True), lambda d: F.struct(field(d, 0, 1).alias("tag"), F.substring(d, 3, 255).alias("data")))


def with_map(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds pcr_pid, info (the program's descriptors as bytes) and components: (type, pid, descriptors as bytes)."""
    b = F.col(body)
    n = (field(b, 2, 2) % 4096).cast("int")
    out = df.withColumn("pcr_pid", field(b, 0, 2) % 8192).withColumn("info", F.substring(b, F.lit(5), n)).withColumn("__rest", F.substring(b, n + 5, F.length(b)))
    entry = lambda e: F.struct(field(e, 0, 1).alias("type"), (field(e, 1, 2) % 8192).alias("pid"), F.substring(e, 6, 4096).alias("descriptors"))
    return out.withColumn("components", F.transform(frames(F.col("__rest"), 5, 3, 2, 0xFFF, whole=True), entry)).drop("__rest")


def access(body: Column) -> Column:
    """(system, pid, private) of an access section's descriptors; others are left out."""
    ours = F.filter(descriptors(body), lambda d: (d["tag"] == ACCESS_TAG) & (F.length(d["data"]) >= 4))
    return F.transform(ours, lambda d: F.struct(field(d["data"], 0, 2).alias("system"), (field(d["data"], 2, 2) % 8192).alias("pid"), F.substring(d["data"], 5, 255).alias("private")))


def grouped(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, table, extension, version, bodies, missing): tables put together from their sections in order of number; repeated sections count once, a table with sections missing has no bodies but their number. A table has 256 sections at most."""
    names = [*keys, "table", "extension", "version"]
    single = df.groupBy(*names, "number").agg(F.min_by("body", F.hex("body")).alias("body"), F.max("last").alias("last"))
    tables = single.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("number", "body"))).alias("__s"), (F.max("last") + 1 - F.count("*")).alias("missing"))
    return tables.withColumn("bodies", F.when(F.col("missing") == 0, F.transform("__s", lambda s: s["body"]))).drop("__s")


def make_section(table: int, extension: Column, body: Column, number: Column | None = None, last: Column | None = None, version: int = 0) -> Column:
    """A section in the long form with its checksum."""
    zero = F.lit(0)
    values = {"table": F.lit(table), "length": F.lit(0xB000) + F.length(body) + 9, "extension": extension, "version": F.lit(0xC1 + 2 * version), "number": zero if number is None else number, "last": zero if last is None else last}
    head = encode([("table", 1, "uint"), ("length", 2, "uint"), ("extension", 2, "uint"), ("version", 1, "uint"), ("number", 1, "uint"), ("last", 1, "uint")], values)
    whole = F.concat(head, body)
    return F.concat(whole, encode([("crc", 4, "uint")], {"crc": crc(whole, 0x04C11DB7, 0xFFFFFFFF, False, 0)}))


def packetise(df: DataFrame, stream: str, pid: str, section: str, order: str = "seq") -> DataFrame:
    """(stream, pid, n, packet): each section in packets of its own, filled up with 0xFF; n counts a stream's packets of a pid, as the counter does."""
    room = PACKET - 4
    whole = F.concat(F.lit(b"\0"), F.col(section))
    count = F.ceil(F.length(whole) / room).cast("int")
    filled = F.concat(whole, F.unhex(F.repeat(F.lit("FF"), count * room - F.length(whole))))
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(filled, k * room + 1, F.lit(room)))
    rows = df.select(stream, pid, order, F.posexplode(pieces).alias("__k", "__piece"))
    rows = rows.withColumn("__o", F.struct(order, "__k")).withColumn("n", F.row_number().over(window("__o", [stream, pid])).cast("long") - 1)
    head = encode([("sync", 1, "uint"), ("pid", 2, "uint"), ("counter", 1, "uint")], {"sync": F.lit(SYNC), "pid": F.col(pid) + F.when(F.col("__k") == 0, 0x4000).otherwise(0), "counter": 0x10 + F.col("n") % 16})
    return rows.select(stream, pid, "n", F.concat(head, F.col("__piece")).alias("packet"))


def adaptation(packet: Column) -> Column:
    """struct(length, discontinuity, random_access, priority, pcr) of packets that have an adaptation field, else null; pcr is in ticks of 27 MHz, null if there is none."""
    there = F.shiftright(field(packet, 3, 1), 5) % 2 == 1
    length = field(packet, 4, 1)
    base = field(packet, 6, 4) * 2 + F.shiftright(field(packet, 10, 1), 7)
    pcr = base * 300 + (field(packet, 10, 1) % 2) * 256 + field(packet, 11, 1)
    some = length > 0
    return F.when(there, F.struct(length.alias("length"), (some & bit(packet, 5, 0)).alias("discontinuity"), (some & bit(packet, 5, 1)).alias("random_access"), (some & bit(packet, 5, 2)).alias("priority"), F.when(some & bit(packet, 5, 3), pcr).alias("pcr")))


#: Ticks after which clock references (of 27 MHz) and time stamps (of 90 kHz) begin again: both have a part of 33 bits.
PCR_TURN, STAMP_TURN = (1 << 33) * 300, 1 << 33


def unwrapped(clock: Column, about: Column, turn: int) -> Column:
    """A clock's time with its turns counted: the clock begins again at `turn`, and of the times that it may mean this is the one nearest to `about`, a coarse time in the same ticks that is less than half a turn off (a packet's place in a stream of constant rate, say)."""
    return about + F.pmod(clock - about + turn // 2, F.lit(turn)) - turn // 2


def _stamp(data: Column, at: int) -> Column:
    """A time stamp of 33 bits in 5 bytes with marker bits."""
    b = [field(data, at + k, 1) for k in range(5)]
    return (F.shiftright(b[0], 1) % 8) * (1 << 30) + b[1] * (1 << 22) + F.shiftright(b[2], 1) * (1 << 15) + b[3] * 128 + F.shiftright(b[4], 1)


def elementary(data: Column) -> Column:
    """struct(stream_id, length, scrambling, pts, dts, payload) of a packetised elementary stream's packet; null without its start code. Ticks are of 90 kHz."""
    flags = F.shiftright(field(data, 7, 1), 6)
    return F.when(
        (field(data, 0, 3) == 1) & (F.length(data) >= 9),
        F.struct(field(data, 3, 1).alias("stream_id"), field(data, 4, 2).alias("length"), (F.shiftright(field(data, 6, 1), 4) % 4).alias("scrambling"), F.when(flags >= 2, _stamp(data, 9)).alias("pts"), F.when(flags == 3, _stamp(data, 14)).alias("dts"), F.substring(data, (field(data, 8, 1) + 10).cast("int"), F.length(data)).alias("payload")),
    )
