"""Records, byte ranges and captures: short input, fields that don't fit, spans, appended files, unknown blocks."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import records
from tidemark.sources import captures, files, ranges

LAYOUT = [("a", 2, "uint"), ("b", 1, "int"), ("c", 2, "bytes")]


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def lit(b):
    return F.lit(bytearray(b))


def test_records_there_and_back(spark):
    df = spark.createDataFrame([(1, 65535, -128, bytearray(b"xy")), (2, 0, 127, bytearray(b"\0\xff"))], "seq long, a long, b long, c binary")
    made = records.joined(df.withColumn("k", F.lit(1)).select("k", "seq", records.encode(LAYOUT).alias("r")), ["k"], F.col("r"))
    assert bytes(made.first().data) == struct.pack(">Hb2s", 65535, -128, b"xy") + struct.pack(">Hb2s", 0, 127, b"\0\xff")
    assert [(r.record_no, r.a, r.b, bytes(r.c)) for r in records.explode(made, records.many(F.col("data"), LAYOUT), ["k"]).collect()] == [(0, 65535, -128, b"xy"), (1, 0, 127, b"\0\xff")]
    wide = [("x", 8, "int"), ("y", 8, "uint")]
    assert tuple(one(spark, records.decode(records.encode(wide, {"x": F.lit(-(1 << 63)), "y": F.lit((1 << 63) - 1)}), wide))) == (-(1 << 63), (1 << 63) - 1)
    for column, value in (("a", 65536), ("a", -1), ("b", 128)):
        bad = df.withColumn(column, F.lit(value))
        assert bad.select(records.encode(LAYOUT, quiet=True).alias("r")).filter("r is not null").count() == 0
        with pytest.raises(Exception, match="doesn't fit"):
            bad.select(records.encode(LAYOUT)).collect()


def test_short_and_bad_input(spark):
    assert one(spark, records.decode(lit(b"1234"), LAYOUT)) is None
    assert one(spark, records.once(lit(b"12"), LAYOUT, quiet=True)[1]) == b"12"
    with pytest.raises(Exception, match="cut short"):
        one(spark, records.once(lit(b"12"), LAYOUT)[0])
    small = [("a", 1, "uint")]
    values = lambda c: [r.a for r in one(spark, c)]
    assert values(records.many(lit(b""), small)) == []
    assert values(records.many(lit(b"\1\2\3"), [("a", 2, "uint")])) == [258]
    assert values(records.many(lit(b"\1\2\3"), small, lambda r: r["a"] != 2, quiet=True)) == [1]
    with pytest.raises(Exception, match="bad record"):
        one(spark, records.many(lit(b"\1\2\3"), small, lambda r: r["a"] != 2))
    with pytest.raises(Exception, match="missing"):
        one(spark, records.counted(lit(b"\3\1\2"), [("n", 1, "uint")], "n", small))
    with pytest.raises(Exception, match="fewer"):
        one(spark, records.isolate(lit(b"\1"), 2))
    assert [bytes(b) for b in one(spark, records.frames(lit(b"\0\1a\0\0\0\3bc"), 2))] == [b"a", b""]
    assert one(spark, records.frames(F.lit(None).cast("binary"))) is None


@pytest.mark.parametrize(("start", "end", "chunk", "span"), [(0, None, 7, 7), (3, 50, 10, 20), (0, 1000, 1000, 1), (99, 100, 1, 1), (200, None, 5, 5)])
def test_byte_ranges(spark, tmp_path, start, end, chunk, span):
    content = bytes(range(100))
    (tmp_path / "f.bin").write_bytes(content)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = ranges.read(spark, str(tmp_path), start, end, chunk, span).orderBy("off").collect()
    assert b"".join(bytes(r.data) for r in got) == content[start:end]
    assert all(len(r.data) <= chunk and (r.off - start) % chunk == 0 for r in got)


def test_captures_are_appended_and_checked(spark, tmp_path):
    captures.register(spark)
    rows = spark.createDataFrame([(1.5, bytearray(b"abc")), (2.000001, bytearray(b""))], "s double, data binary").select(F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"), "data")
    for kind in ("pcap", "pcapng"):
        for _ in range(2):
            rows.coalesce(1).write.format(kind).mode("append").save(str(tmp_path / kind))
        back = spark.read.format(kind).load(str(tmp_path / kind))
        assert sorted((r.us, bytes(r.data)) for r in back.select(F.unix_micros("ts").alias("us"), "data").collect()) == sorted([(1_500_000, b"abc"), (2_000_001, b"")] * 2)
    (tmp_path / "x.pcapng").write_bytes(captures.block(captures.PCAPNG_SECTION, struct.pack("<IHHq", captures.PCAPNG_ORDER, 1, 0, -1)) + captures.block(4, b"names") + captures.block(77, b""))
    blocks = spark.read.format("pcapng_blocks").load(str(tmp_path / "x.pcapng"))
    assert [r.name for r in blocks.orderBy("seq").select(captures.named(F.col("kind"), captures.BLOCKS).alias("name")).collect()] == ["section", "name resolution", "unknown"]


def test_header_checksums(spark):
    # The example header of RFC 1071 style texts: its checksum is 0xB861.
    header = bytes.fromhex("45000073000040004011b861c0a80001c0a800c7")
    assert one(spark, captures.checksum(lit(header), 0, F.lit(20))) == 0
    assert one(spark, captures.checksum(lit(header[:10] + b"\0\0" + header[12:]), 0, F.lit(20))) == 0xB861
    assert one(spark, captures.checksum(lit(b"\1" + header[1:]), 0, F.lit(20))) != 0


def test_lines_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "seq long, line string").repartition(3)
    files.write_lines(df, str(tmp_path / "out"), "line")
    names = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(p.read_bytes() for p in names) == b"a\nb\n\n"
