"""Program tables from sections over several packets, time stamps, and texts joined and split again against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import records
from tidemark.operators import grouping, ordered
from tidemark.sources import program_tables as tables
from tidemark.sources import transport


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("size", [0, 1, 170, 171, 172, 400, 1000])
def test_sections_survive_packets(spark, size):
    rows = spark.createDataFrame([("a", 5, k, bytearray(bytes([k]) * size)) for k in range(3)], "stream string, pid int, seq long, body binary")
    packets = tables.packetise(rows.withColumn("section", tables.make_section(2, F.lit(7), F.col("body"), F.col("seq"), F.lit(2), 5)), "stream", "pid", "section")
    assert all(len(r.packet) == transport.PACKET for r in packets.collect())
    back = tables.with_section(transport.sections(packets, "stream", "n")).orderBy("number").collect()
    assert [(r.error, r.table, r.extension, r.version, r.current, r.number, r.last, bytes(r.body)) for r in back] == [(None, 2, 7, 5, True, k, 2, bytes([k]) * size) for k in range(3)]


def test_tables_need_all_sections(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0, n, 2, bytearray([n])) for n in (0, 2, 2)] + [("b", 0, 1, 0, n, 1, bytearray([n])) for n in (1, 0)], "stream string, table long, extension long, version long, number long, last long, body binary")
    assert [(r.stream, r.missing, r.bodies and [bytes(b) for b in r.bodies]) for r in tables.grouped(rows, "stream").orderBy("stream").collect()] == [("a", 1, None), ("b", 0, [b"\0", b"\1"])]


def test_fields_of_packets(spark):
    lit = lambda b: F.lit(bytearray(b))
    assert one(spark, tables.descriptors(lit(b"\x09\x02ab\x0a\x00\x0b\x05x"))) == [(9, b"ab"), (10, b"")]
    assert one(spark, tables.programs(lit(b""))) == []
    pes = bytes.fromhex("000001e0000a80c00a") + bytes([0x3F, 0xFF, 0xFF, 0xFF, 0xFF]) + bytes([0x11, 0, 1, 0, 3]) + b"xyz"
    got = one(spark, tables.elementary(lit(pes)))
    assert (got.stream_id, got.pts, got.dts, bytes(got.payload)) == (0xE0, (1 << 33) - 1, 1, b"xyz")
    assert one(spark, tables.elementary(lit(b"\0\0\2" + pes[3:]))) is None
    assert one(spark, tables.adaptation(lit(b"\x47\0\0\x10" + bytes(184)))) is None
    assert one(spark, tables.adaptation(lit(b"\x47\0\0\x20\0" + bytes(183)))).pcr is None


@pytest.mark.parametrize("keyed", [True, False])
def test_resplit_is_join_and_split(spark, keyed):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if keyed else "a", i, rng.choice([None, "", "|", "x", "y|", "|z", "p|q|r", "||"])) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, seq long, text string")
    got = grouping.resplit(df, "|", key="lang" if keyed else None).collect()
    for key in {k for k, _, _ in rows}:
        whole = "".join(t or "" for k, _, t in rows if k == key).split("|")
        whole = whole if whole[-1] else whole[:-1]
        mine = [tuple(r)[1 if keyed else 0 :] for r in got if not keyed or r[0] == key]
        mine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert [r[2] for r in mine] == whole
    assert grouping.resplit(df.limit(0), "|").count() == 0


def test_numbers_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPREAD", 4)
    df = spark.createDataFrame([(-3, 9), (5, 5), (6, 2)], "a long, b long")
    got = sorted((r.a, r.n) for r in ordered.spread(df, F.col("a"), F.col("b"), "n").collect())
    assert got == [(-3, n) for n in range(-3, 10)] + [(5, 5)]


def test_framing_by_a_masked_length(spark):
    data = F.lit(bytearray(b"\x01\xf0\x02ab\x02\xf0\x00\x03\xf0\x09x"))
    assert [bytes(b) for b in one(spark, records.frames(data, 3, 1, 2, 0xFFF))] == [b"ab", b""]
    assert [bytes(b) for b in one(spark, records.frames(data, 3, 1, 2, 0xFFF, whole=True))] == [b"\x01\xf0\x02ab", b"\x02\xf0\x00"]
