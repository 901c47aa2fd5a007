"""Options, clocks and names of pcapng blocks against bytes that are packed by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import captures, pcapng


def entry(order, code, value):
    return struct.pack(f"{order}HH", code, len(value)) + value + bytes(-len(value) % 4)


def one(spark, order, body, f):
    return spark.createDataFrame([(order == "<", bytes(body))], "little boolean, body binary").select(f(F.col("body"), F.col("little")).alias("x")).first()["x"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_lists(spark, order):
    body = entry(order, 1, b"abc") + entry(order, 7, b"") + entry(order, 1, b"12345678") + struct.pack(f"{order}HH", 0, 0) + entry(order, 9, b"no")
    got = one(spark, order, b"head" + body, lambda b, le: pcapng.entries(b, 4, le))
    assert [(e["code"], bytes(e["value"])) for e in got["list"]] == [(1, b"abc"), (7, b""), (1, b"12345678")] and got["end"] == 4 + 8 + 4 + 12 + 4
    assert one(spark, order, entry(order, 3, b"abcd")[:-1], lambda b, le: pcapng.entries(b, 0, le))["list"] == []
    assert one(spark, order, b"", lambda b, le: pcapng.entries(b, 0, le))["list"] == []


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("resolution,per", [(None, 10**6), (9, 10**9), (0x80 | 30, 1 << 30)])
def test_clocks(spark, order, resolution, per):
    head = struct.pack(f"{order}HHI", 1, 0, 96)
    idb = head + (entry(order, pcapng.IF_TSRESOL, bytes([resolution])) if resolution is not None else b"") + entry(order, pcapng.IF_NAME, b"eth0") + entry(order, pcapng.IF_TSOFFSET, struct.pack(f"{order}q", 5)) + bytes(4)
    seconds, part = 1_700_000_000 if per <= 10**9 else 1_000_000, 0.25 if per > 1 else 0
    at = int(seconds * per) + int(part * per)
    epb = lambda k: struct.pack(f"{order}IIIII", k, at >> 32, at & 0xFFFFFFFF, 3, 60) + b"abc\0"
    rows = [(captures.PCAPNG_SECTION, b""), (captures.INTERFACE, head), (captures.INTERFACE, idb), (captures.ENHANCED, epb(1)), (captures.PCAPNG_SECTION, b""), (captures.INTERFACE, idb), (captures.ENHANCED, epb(0)), (captures.ENHANCED, epb(3))]
    df = spark.createDataFrame([("f", i, order == "<", k, b) for i, (k, b) in enumerate(rows)], "path string, seq long, little boolean, kind long, body binary")
    got = pcapng.packets(df).orderBy("seq").collect()
    us = (seconds + 5) * 10**6 + int(part * 10**6)
    assert [(r["seq"], r["us"], r["name"], r["interface"], bytes(r["data"]), r["orig_len"]) for r in got] == [(3, us, "eth0", 1, b"abc", 60), (6, us, "eth0", 0, b"abc", 60), (7, None, None, 3, b"abc", 60)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_statistics_and_names(spark, order):
    body = struct.pack(f"{order}III", 2, 1, 5) + entry(order, pcapng.ISB_STARTTIME, struct.pack(f"{order}II", 1, 2)) + entry(order, pcapng.ISB_IFRECV, struct.pack(f"{order}Q", 77))
    got = one(spark, order, body, pcapng.statistics)
    assert tuple(got) == (2, (1 << 32) + 5, (1 << 32) + 2, None, 77, None)
    body = entry(order, 1, b"\x7f\0\0\x01localhost\0lo\0") + entry(order, 9, b"??") + entry(order, 2, bytes(15) + b"\x01ip6\0") + bytes(4)
    got = one(spark, order, body, pcapng.names)
    assert [(r["address"], r["names"]) for r in got] == [("127.0.0.1", ["localhost", "lo"]), ("0000:0000:0000:0000:0000:0000:0000:0001", ["ip6"])]
