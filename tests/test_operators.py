"""Stated example vectors and list models of the sequence operators."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import compression, hashing, text
from tidemark.operators import folding, generators, grouping, pairing, scans, selection, timeseries
from tidemark.operators import ordered
from tidemark.sources import captures, files, transport


def seq(spark, values, kind="int", parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"seq long, v {kind}").repartition(parts)


def got(df, order="seq", col="v"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_prefixes(spark):
    e = seq(spark, [1, 2, 3, 4, 3, 2, 1])
    assert got(selection.take_while(e, F.col("v") < 4)) == [1, 2, 3]
    assert got(selection.take_through(e, F.col("v") < 4)) == [1, 2, 3, 4]
    assert got(selection.drop_while(e, F.col("v") < 4)) == [4, 3, 2, 1]
    assert got(selection.drop_through(e, F.col("v") < 4)) == [3, 2, 1]
    assert got(selection.delete_first(e, F.col("v") == 3)) == [1, 2, 4, 3, 2, 1]
    assert got(selection.drop_right(e, 2)) == [1, 2, 3, 4, 3]
    assert got(selection.take_right(e, 2)) == [2, 1]
    assert got(selection.drop_last_if(e, F.col("v") == 1)) == [1, 2, 3, 4, 3, 2]
    assert got(selection.take_while(e, F.col("v") < 9)) == [1, 2, 3, 4, 3, 2, 1]
    assert got(selection.drop_while(e, F.col("v") < 9)) == []


def test_limit_fails_when_exceeded(spark):
    assert selection.limit(seq(spark, [1, 2]), 2).count() == 2
    with pytest.raises(Exception, match="more than 1 rows"):
        selection.limit(seq(spark, [1, 2]), 1).collect()


def test_changes_and_runs(spark):
    e = seq(spark, [1, 1, None, None, 2, 1])
    assert got(selection.changes_by(e, F.col("v"))) == [1, None, 2, 1]
    e = seq(spark, range(12))
    rows = grouping.group_adjacent_by_limit(e, F.floor(F.col("v") / 4), 3).groupBy("run", "part").count().orderBy("run", "part").collect()
    assert [r["count"] for r in rows] == [3, 1, 3, 1, 3, 1]


@pytest.mark.parametrize("n", [0, 1, 5, 7])
@pytest.mark.parametrize(("size", "step"), [(1, 1), (2, 1), (3, 2), (2, 3), (4, 4), (9, 2)])
def test_sliding_is_list_sliding(spark, n, size, step):
    def model(xs):
        out, i = [], 0
        while i < len(xs):
            out.append(xs[i : i + size])
            if i + size >= len(xs):
                break
            i += step
        return out

    rows = grouping.sliding(seq(spark, list(range(n)), parts=2), size, step).orderBy("window", "at").collect()
    found = {}
    for r in rows:
        found.setdefault(r["window"], []).append(r["v"])
    assert list(found.values()) == model(list(range(n)))


def test_split(spark):
    sizes = lambda xs: [r["n"] for r in grouping.split_sizes(seq(spark, xs), F.col("v") == 0).orderBy("group").collect()]
    assert sizes([1, 2, 0, 0, 3, 0, 4]) == [2, 0, 1, 1]
    assert sizes([1, 2, 0, 0, 3, 0]) == [2, 0, 1]
    assert sizes([1, 2, 0, 0, 3, 0, 0]) == [2, 0, 1, 0]


def test_pairing(spark):
    a, b = seq(spark, [1, 2, 3]), seq(spark, [4, 5, 6, 7])
    z = pairing.zip_all(a, b).orderBy("pos").collect()
    assert [(r.l.v if r.has_l else 0, r.r.v if r.has_r else 0) for r in z] == [(1, 4), (2, 5), (3, 6), (0, 7)]
    assert got(pairing.interleave(a, b), "pos") == [1, 4, 2, 5, 3, 6]
    assert got(pairing.interleave_all(a, b), "pos") == [1, 4, 2, 5, 3, 6, 7]
    x, y = seq(spark, [1, 2, 5, 6]).drop("seq"), seq(spark, [0, 2, 3, 4]).drop("seq")
    assert got(pairing.interleave_ordered(x, y, "v"), "pos") == [0, 1, 2, 2, 3, 4, 5, 6]


def test_folds_of_nothing(spark):
    none = seq(spark, [])
    assert folding.fold(none, F.col("v")).first()[0] == 0
    assert folding.fold1(none, F.col("v")).count() == 0
    assert selection.exists(none, F.col("v") > 0).first()[0] is False
    assert selection.forall(none, F.col("v") > 0).first()[0] is True


def test_scan_begins_with_its_seed(spark):
    assert got(folding.scan(seq(spark, [1, 2, 3]), F.col("v"), seed=10), "pos", "state") == [10, 11, 13, 16]


def test_blocks_agree_with_windows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    e = seq(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], parts=5)
    assert got(ordered.running(e, F.col("v"), "s"), col="s") == [3, 4, 8, 9, 14, 23, 25, 31, 36, 39, 44]
    assert got(ordered.running(e, F.col("v"), "s", "max"), col="s") == [3, 3, 4, 4, 5, 9, 9, 9, 9, 9, 9]
    n = grouping.zip_with_neighbours(e, "v").orderBy("seq").collect()
    assert [r.previous for r in n] == [None, 3, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    assert [r.next for r in n] == [1, 4, 1, 5, 9, 2, 6, 5, 3, 5, None]


def test_rate_vectors(spark):
    def rated(rows, period):
        df = spark.createDataFrame([(i, t * 1000, v) for i, (t, v) in enumerate(rows)], "seq long, us long, v int").withColumn("ts", F.timestamp_micros("us"))
        return [(int(r.ts.timestamp() * 1000), r.total) for r in timeseries.rate(df, period * 1000, F.col("v")).select(F.col("ts"), "total").orderBy("ts").collect()]

    assert rated([(0, 1), (500, 2), (1000, 1), (2300, 2)], 1000) == [(1000, 3), (2000, 1), (3000, 2)]
    assert rated([(0, 1), (500, 2), (1000, 1), (2300, 2)], 2000) == [(2000, 4), (4000, 2)]
    assert rated([(0, 1), (3300, 2)], 1000) == [(1000, 1), (2000, 0), (3000, 0), (4000, 2)]


def test_increasing_and_ticks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, -2, -1, 1, 5, 3, 6])], "seq long, v int").withColumn("ts", F.timestamp_seconds(F.col("v")))
    assert got(timeseries.increasing(df)) == [0, 1, 5, 6]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([1000, 2000, 3000])], "seq long, v int").withColumn("ts", F.timestamp_millis(F.col("v")))
    ticks = timeseries.interpolate_ticks(df, 300_000, "v").filter("is_tick").orderBy("ts").collect()
    assert [round(r.ts.timestamp() * 1000) for r in ticks] == [1300, 1600, 1900, 2200, 2500, 2800]


def test_machines_in_batch_and_stream(spark, tmp_path):
    e = seq(spark, [1, 9, 5, 6, 7, 8, 9, 10]).withColumn("k", F.lit(1)).select("k", "seq", F.col("v").cast("double").alias("value"))
    keep = scans.FilterWithPrevious(lambda a, b: b > a)
    assert got(scans.run(e, keep, "k int, seq long, value double", "k"), col="value") == [1, 9, 10]
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = scans.run_stream(stream, keep, "k int, seq long, value double", "k").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got(spark.table("kept"), col="value") == [1, 9, 10]
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Hel", "l", "o Wor", "ld"])], "k int, seq long, text string")
    pieces = scans.run(words, scans.Resplit(" "), "k int, seq long, n int, piece string", "k").collect()
    assert sorted(r.piece for r in pieces) == ["Hello", "World"]
    us = spark.createDataFrame([(1, i, t * 1000, v) for i, (t, v) in enumerate([(0, 1), (0, 2), (0, 3), (500, 4), (500, 5), (510, 6)])], "k int, seq long, us long, v int")
    assert got(scans.run(us, scans.Debounce(100_000), "k int, seq long, us long, v int", "k")) == [3, 6]


def test_generators(spark):
    assert generators.range_(spark, 0, 5, 0).count() == 0
    assert got(generators.iterate(spark, "1", "v * 2", "v < 20")) == [1, 2, 4, 8, 16, 32]
    assert [(r.lo, r.hi) for r in generators.ranges(spark, 0, 10, 4).orderBy("lo").collect()] == [(0, 4), (4, 8), (8, 10)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.lines(F.lit("a\r\nb\rc\nd\n"))) == ["a", "b", "c", "d", ""]
    assert one(text.lines(F.lit(""))) == []
    assert one(text.utf8_decode(F.lit(bytearray(b"\xef\xbb\xbfa\xffb")))) == "a�b"
    assert one(text.base64_decode(F.lit("####"))) is None
    assert one(text.base64_decode(F.lit("aGk="))) == b"hi"
    assert one(text.hex_decode(F.lit("abc"))) is None
    assert one(text.hex_decode(F.lit("0xAb C0"))) == b"\xab\xc0"
    assert one(text.decode(F.lit(bytearray("你".encode("gb2312"))), "gb2312")) == "你"


def test_hashes_and_compression(spark):
    data = F.lit(bytearray(b"123456789"))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(hashing.crc32c(data)) == 0xE3069283
    assert one(hashing.crc(data, 0x04C11DB7, 0xFFFFFFFF, True, 0xFFFFFFFF)) == zlib.crc32(b"123456789")
    for form in compression.BITS:
        assert one(compression.inflate(compression.deflate(data, form), form)) == b"123456789"


def test_captures(spark, tmp_path):
    frame = bytes(12) + b"\x08\x00" + bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HHHH", 53, 4000, 20, 0)
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 5, 250, len(frame), len(frame)) + frame)
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    packet = struct.pack("<IIIII", 0, 0, 7_000_000, len(frame), len(frame)) + frame + bytes(-len(frame) % 4)
    (tmp_path / "a.pcapng").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(99, b"what") + block(6, packet))
    captures.register(spark)
    for name in ("pcap", "pcapng"):
        r = captures.with_headers(spark.read.format(name).load(str(tmp_path / f"a.{name}"))).collect()
        assert len(r) == 1
        assert bytes(r[0].data) == frame
        assert (r[0].ip.src, r[0].ip.dst, r[0].ip.protocol, r[0].ports.src, r[0].ports.dst) == ("10.0.0.1", "10.0.0.2", 17, 53, 4000)


def test_sections(spark):
    payload = bytes([0x00, 0xB0, 13]) + bytes(9)
    section = payload + struct.pack(">I", transport.crc_mpeg(payload))
    assert transport.crc_mpeg(section) == 0
    first = bytes([0x47, 0x40, 0, 0x10]) + b"\x00" + section
    rows = spark.createDataFrame([("f", 0, bytearray(first + b"\xff" * (188 - len(first)))), ("f", 1, bytearray(bytes([0x47, 0x40, 0, 0x13]) + b"\x00" + section + b"\xff" * (183 - len(section))))], "s string, n long, packet binary")
    out = transport.sections(rows, "s", "n").orderBy("seq", "error").collect()
    assert [bytes(r.section) for r in out if r.section] == [section, section]
    assert [r.error for r in out if r.error] == ["counter 3 after 0"]


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"one\r\ntwo\n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == ["one", "two", ""]
    assert bytes(files.read_range(spark, str(tmp_path / "t.txt"), 1, 3).first().data) == b"ne"
    assert b"".join(bytes(r.data) for r in files.read_chunks(spark, str(tmp_path / "t.txt"), 4).orderBy("off").collect()) == b"one\r\ntwo\n"
    assert files.walk(spark, str(tmp_path)).first().length == 9
