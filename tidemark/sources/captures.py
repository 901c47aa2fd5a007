"""Packet captures as data sources: pcap and pcapng files, one partition per file, and header columns of their packets.

`register(spark)` adds the formats "pcap" and "pcapng". A file is read front to back in pieces; its records are independent of other files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.functions.records import bit, field
from tidemark.sources.paths import listed, opened, store_of

SCHEMA = "path string, seq long, ts timestamp, link int, incl_len long, orig_len long, data binary"
# Magic numbers of the two formats.
PCAP_MICROS, PCAP_NANOS = 0xA1B2C3D4, 0xA1B23C4D
PCAPNG_SECTION, PCAPNG_ORDER = 0x0A0D0D0A, 0x1A2B3C4D
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _exactly(stream, n: int) -> bytes | None:
    got = stream.read(n)
    if not got:
        return None
    if len(got) < n:
        raise ValueError("a capture ends inside a record")
    return got


def read_pcap(stream) -> Iterator[tuple]:
    """(ts, link, incl_len, orig_len, data) of each record."""
    head = _exactly(stream, 24)
    if head is None:
        return
    for order in "<>":
        magic, _, _, zone, _, _, link = struct.unpack(f"{order}IHHiIII", head)
        if magic in (PCAP_MICROS, PCAP_NANOS):
            break
    else:
        raise ValueError("not a pcap file")
    per = 1_000 if magic == PCAP_NANOS else 1
    while (r := _exactly(stream, 16)) is not None:
        sec, frac, incl, orig = struct.unpack(f"{order}IIII", r)
        yield _EPOCH + timedelta(seconds=sec + zone, microseconds=frac // per), link, incl, orig, _exactly(stream, incl) if incl else b""


def read_blocks(stream) -> Iterator[tuple[str, int, bytes]]:
    """(byte order, type, body) of each pcapng block; unknown types too."""
    order = "<"
    while (head := _exactly(stream, 8)) is not None:
        kind = struct.unpack_from("<I", head)[0]
        if kind == PCAPNG_SECTION:
            mark = _exactly(stream, 4)
            order = "<" if struct.unpack("<I", mark)[0] == PCAPNG_ORDER else ">"
            length = struct.unpack_from(f"{order}I", head, 4)[0]
            body = mark + _exactly(stream, length - 16)
        else:
            kind, length = struct.unpack(f"{order}II", head)
            body = _exactly(stream, length - 12) if length > 12 else b""
        if struct.unpack(f"{order}I", _exactly(stream, 4))[0] != length:
            raise ValueError("a block's two lengths differ")
        yield order, kind, body


def read_pcapng(stream) -> Iterator[tuple]:
    """(ts, link, incl_len, orig_len, data) of packet blocks, timestamps in microseconds."""
    links: list[int] = []
    for order, kind, body in read_blocks(stream):
        if kind == PCAPNG_SECTION:
            links = []
        elif kind == INTERFACE:
            links.append(struct.unpack_from(f"{order}H", body)[0])
        elif kind == ENHANCED:
            which, hi, lo, incl, orig = struct.unpack_from(f"{order}IIIII", body)
            yield _EPOCH + timedelta(microseconds=(hi << 32) + lo), links[which], incl, orig, body[20 : 20 + incl]
        elif kind == SIMPLE:
            orig = struct.unpack_from(f"{order}I", body)[0]
            yield None, links[0], min(orig, len(body) - 4), orig, body[4 : 4 + orig]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def partitions(self):
        return [_File(p) for p, _ in listed(self.path)] or [_File("")]

    def read(self, partition):
        if partition.path:
            with opened(partition.path) as stream:
                for k, row in enumerate(self.parse(stream)):
                    yield (partition.path, k, *row)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    """A file per task, written under a name that readers pass over and renamed once all tasks are done; files of failed attempts are never renamed."""

    def __init__(self, folder: str, start: bytes, record, extension: str):
        self.folder, self.first, self.record, self.extension = folder, start, record, extension

    def write(self, iterator):
        store, folder = store_of(self.folder)
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{folder}/_{name}") as out:
            out.write(self.first)
            for row in iterator:
                out.write(self.record(row["ts"], bytes(row["data"])))
        return _Written(name)

    def commit(self, messages):
        store, folder = store_of(self.folder)
        for k, m in enumerate(messages):
            store.move(f"{folder}/_{m.name}", f"{folder}/part-{k:05d}-{m.name}.{self.extension}")

    def abort(self, messages):
        store, folder = store_of(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/_{m.name}")


def _micros(ts: datetime) -> int:
    return (ts.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


def pcap_record(ts: datetime, data: bytes) -> bytes:
    sec, frac = divmod(_micros(ts), 1_000_000)
    return struct.pack("<IIII", sec, frac, len(data), len(data)) + data


def block(kind: int, body: bytes) -> bytes:
    """A pcapng block: its length before and after a body that is filled up to four bytes."""
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def pcapng_record(ts: datetime, data: bytes) -> bytes:
    us = _micros(ts)
    return block(ENHANCED, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)


ETHERNET, SNAP = 1, 1 << 18


class PcapSource(DataSource):
    """Reads captures; writes (ts, data) rows of Ethernet frames, a file per task."""

    parse = staticmethod(read_pcap)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], struct.pack("<IHHiIII", PCAP_MICROS, 2, 4, 0, 0, SNAP, ETHERNET), pcap_record, "pcap")

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.parse)


class PcapngSource(PcapSource):
    parse = staticmethod(read_pcapng)

    @classmethod
    def name(cls):
        return "pcapng"

    def writer(self, schema, overwrite):
        start = block(PCAPNG_SECTION, struct.pack("<IHHq", PCAPNG_ORDER, 1, 0, -1)) + block(INTERFACE, struct.pack("<HHI", ETHERNET, 0, SNAP))
        return _Writer(self.options["path"], start, pcapng_record, "pcapng")


class PcapngBlocks(PcapSource):
    """All blocks of pcapng files as they are: (path, seq, big_endian, kind, body)."""

    parse = staticmethod(lambda stream: ((order == ">", kind, body) for order, kind, body in read_blocks(stream)))

    @classmethod
    def name(cls):
        return "pcapng_blocks"

    def schema(self):
        return "path string, seq long, big_endian boolean, kind long, body binary"

    def writer(self, schema, overwrite):
        raise ValueError("blocks can't be written")


def register(spark: SparkSession) -> None:
    for source in (PcapSource, PcapngSource, PcapngBlocks):
        spark.dataSource.register(source)


def unsigned(data: Column, at, n: int) -> Column:
    """Big-endian unsigned number of n bytes at an offset."""
    place = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.conv(F.hex(F.substring(data, place, F.lit(n)) if isinstance(place, Column) else data), 16, 10).cast("long")


def with_headers(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds eth (dst, src, ether_type), ip (version, protocol, ttl, src, dst, header length) and ports of Ethernet frames, by byte arithmetic in the JVM; null where a header isn't there."""
    d = F.col(data)
    mac = lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.lower(F.hex(F.substring(d, k + at + 1, F.lit(1))))), ":")
    dotted = lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.hex(F.substring(d, k + at + 1, F.lit(1))), 16, 10)), ".")
    out = df.withColumn("eth", F.when(F.length(d) >= 14, F.struct(mac(0).alias("dst"), mac(6).alias("src"), unsigned(d, 12, 2).alias("ether_type"))))
    first = unsigned(d, 14, 1)
    size = (first % 16) * 4
    out = out.withColumn(
        "ip",
        F.when(
            (F.col("eth.ether_type") == 0x0800) & (F.length(d) >= 34),
            F.struct(F.lit(4).alias("version"), size.alias("header_bytes"), unsigned(d, 16, 2).alias("total_bytes"), unsigned(d, 22, 1).alias("ttl"), unsigned(d, 23, 1).alias("protocol"), dotted(26).alias("src"), dotted(30).alias("dst")),
        ).when(
            (F.col("eth.ether_type") == 0x86DD) & (F.length(d) >= 54),
            F.struct(F.lit(6).alias("version"), F.lit(40).cast("long").alias("header_bytes"), (unsigned(d, 18, 2) + 40).alias("total_bytes"), unsigned(d, 21, 1).alias("ttl"), unsigned(d, 20, 1).alias("protocol"), F.lower(F.hex(F.substring(d, 23, 16))).alias("src"), F.lower(F.hex(F.substring(d, 39, 16))).alias("dst")),
        ),
    )
    at = (F.col("ip.header_bytes") + 14).cast("int")
    return out.withColumn("ports", F.when(F.col("ip.protocol").isin(6, 17) & (F.length(d) >= at + 4), F.struct(unsigned(d, at, 2).alias("src"), unsigned(d, at + 2, 2).alias("dst"))))


#: Names of block kinds.
BLOCKS = {PCAPNG_SECTION: "section", INTERFACE: "interface", 2: "packet", SIMPLE: "simple packet", 4: "name resolution", 5: "interface statistics", ENHANCED: "enhanced packet", 0x80000001: "process information"}
#: Names of link types.
LINKS = {0: "null", 1: "ethernet", 101: "raw", 113: "linux_sll", 228: "ipv4", 229: "ipv6", 243: "mpeg2_ts"}
#: The flag bits of a TCP header, from the highest.
TCP_FLAGS = ("cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin")


def named(column: Column, names: dict[int, str]) -> Column:
    """The name of a number, "unknown" for others."""
    return F.coalesce(F.element_at(F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in names]), F.array(*[F.lit(v) for v in names.values()])), column.cast("long")), F.lit("unknown"))


def checksum(data: Column, at, n: Column) -> Column:
    """The ones' complement sum of the 16-bit words of n bytes (an even number) at an offset: 0 over an intact header that holds its checksum."""
    place = at if isinstance(at, Column) else F.lit(at)
    total = F.aggregate(F.sequence(F.lit(0), (n / 2).cast("int") - 1), F.lit(0).cast("long"), lambda s, k: s + field(data, place + k * 2, 2))
    fold = lambda s: s % 65536 + F.floor(s / 65536)
    return F.lit(65535) - fold(fold(total))


def with_transport(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds to with_headers(df) ip_options (bytes between the first 20 and the header's end), ip_intact (its checksum holds), tcp and udp: fields, flags, and where the payload is. Null where a header isn't there."""
    d, out = F.col(data), df
    begin = (F.col("ip.header_bytes") + 14).cast("int")
    v4 = F.col("ip.version") == 4
    out = out.withColumn("ip_options", F.when(v4, F.substring(d, F.lit(35), begin - 34))).withColumn("ip_intact", F.when(v4 & (F.length(d) >= begin), checksum(d, 14, begin - 14) == 0))
    offset = F.shiftright(field(d, begin + 12, 1), 4) * 4
    flags = F.struct(*[bit(d, begin + 13, k).alias(f) for k, f in enumerate(TCP_FLAGS)])
    numbers = [field(d, begin + at, n).alias(name) for name, at, n in (("src", 0, 2), ("dst", 2, 2), ("sequence", 4, 4), ("acknowledgement", 8, 4), ("window", 14, 2), ("checksum", 16, 2), ("urgent", 18, 2))]
    tcp = F.struct(*numbers, offset.alias("header_bytes"), flags.alias("flags"), (begin + offset).alias("payload_at"))
    udp = F.struct(*[field(d, begin + 2 * k, 2).alias(name) for k, name in enumerate(("src", "dst", "length", "checksum"))], (begin + 8).alias("payload_at"))
    return out.withColumn("tcp", F.when((F.col("ip.protocol") == 6) & (F.length(d) >= begin + 20), tcp)).withColumn("udp", F.when((F.col("ip.protocol") == 17) & (F.length(d) >= begin + 8), udp))
