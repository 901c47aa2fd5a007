"""Checksums against the bytewise rule, ends that must exist, time-outs between rows, and stateful maps."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import CRC_BLOCK, Crc, crc_table
from tidemark.operators import generators, grouping, outcomes, scans, selection
from tidemark.sources import files


def bytewise(data, polynomial, initial, reflected, final_xor, width):
    table, full, r = crc_table(polynomial, width, reflected), (1 << width) - 1, initial
    for x in data:
        r = table[(r ^ x) & 255] ^ (r >> 8) if reflected else table[((r >> (width - 8)) ^ x) & 255] ^ ((r << 8) & full)
    return r ^ final_xor


@pytest.mark.parametrize("kind", [(0x1EDC6F41, 0xFFFFFFFF, True, 0xFFFFFFFF, 32), (0x04C11DB7, 0xFFFFFFFF, False, 0, 32), (0x1021, 0x1D0F, False, 0, 16), (0x07, 0, False, 0x55, 8), (0x42F0E1EBA9EA3693, (1 << 64) - 1, True, (1 << 64) - 1, 64)])
def test_checksums_of_many_strings(kind):
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (*range(10), CRC_BLOCK - 1, CRC_BLOCK, CRC_BLOCK + 1, 2 * CRC_BLOCK, 40_000, *(rng.randrange(3000) for _ in range(20)))]
    assert Crc(*kind).of(data) == [bytewise(x, *kind) for x in data]
    assert Crc(*kind).of([]) == []


def test_ends_that_must_exist(spark):
    df = spark.createDataFrame([(2, 5.0), (1, None)], "seq long, value double")
    empty = df.limit(0)
    assert [tuple(r) for r in selection.last_option(df).select("seq", "value", "found").collect()] == [(2, 5.0, True)]
    assert [tuple(r) for r in selection.last_option(empty).select("seq", "value", "found").collect()] == [(None, None, False)]
    assert selection.or_error(selection.head(df), "none").first()["seq"] == 1
    with pytest.raises(Exception, match="nothing here"):
        selection.or_error(empty, "nothing here").collect()
    assert sorted((r.seq, r.in_head) for r in selection.uncons_n(df, 1).collect()) == [(1, True), (2, False)]


def test_timeouts_between_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 100), (4, 101)], "seq long, s long").select("seq", F.timestamp_seconds("s").alias("ts"))
    other = df.filter("seq = 4")
    got = lambda limit: sorted((r.part, r.seq) for r in outcomes.timeout_on_pull_to(df, limit * 1_000_000, other).collect())
    assert got(50) == [(0, 1), (0, 2), (1, 4)]
    assert got(90) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert outcomes.timeout_on_pull_to(df.limit(0), 1, other).count() == 0


def test_stateful_maps(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 1, 3), (2, 1, 7)], "k long, seq long, n long")
    made = scans.run(df, scans.Accumulate(0, lambda s, r: (s + r.n, -r.n), 2, True), "k long, seq long, n long, state long, out long", "k")
    assert sorted((r.k, r.state, r.seq or 0) for r in made.collect()) == [(1, 0, 0), (1, 3, 1), (1, 8, 2), (2, 0, 0), (2, 7, 1)]
    chunked = grouping.scan_chunks(df.withColumn("chunk", F.col("seq")), "chunk", F.col("n"))
    assert sorted((r.chunk, r.n, r.total, r.state) for r in chunked.collect()) == [(1, 2, 10, 10), (2, 1, 5, 15)]


def test_unfolding_by_chunk_and_loop(spark):
    chunks = generators.unfold_chunk(spark, 0, lambda i: ([i] * (i % 2), i + 1) if i < 6 else None, "long")
    assert [r.value for r in chunks.orderBy("seq").collect()] == [1, 3, 5]
    assert [r.value for r in generators.unfold_loop(spark, 4, lambda i: (i, None), "long").collect()] == [4]
    assert [r.us for r in generators.fixed_rate(spark, 10, 5, 2, True).orderBy("seq").collect()] == [10, 15]


def test_rotation_without_a_key(spark):
    df = spark.createDataFrame([(i, "x" * 9) for i in range(6)], "seq long, text string")
    assert [r.file for r in files.rotated(df, "text", 20).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]


def test_unfolding_has_no_limit(spark):
    got = generators.unfold(spark, 0, lambda i: (i, i + 1) if i < 1_200_000 else None, "long")
    assert got.selectExpr("max(seq)", "sum(value)").first() == (1_199_999, 1_200_000 * 1_199_999 // 2)
    assert generators.unfold_chunk(spark, 0, lambda i: (range(30_000), 1) if i < 1 else None, "long").count() == 30_000
