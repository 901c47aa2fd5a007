"""Runs of neighbouring rows: as few as the input's layout allows, and the same results by any layout."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import grouping, packed, pieces


@pytest.fixture(params=[7, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_in_order_are_one_run(spark):
    rows = [(k, i * 5, bytes([k, i % 256])) for k in range(6) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, off long, data binary").coalesce(1)
    runs = packed.packed(df, ["k"], "off", "data").orderBy("k").collect()
    assert [(r["k"], r["__lo"], r["__hi"], len(r["__sizes"]), bytes(r["__value"])) for r in runs] == [(k, 0, 299 * 5, 300, b"".join(p for x, _, p in rows if x == k)) for k in range(6)]
    mixed = packed.packed(df.withColumn("r", F.col("off") % 7).sort("r"), ["k"], "off", "data").groupBy("k").agg(F.max(F.size("__sizes")).alias("n")).collect()
    assert all(r["n"] > 7 for r in mixed)


@pytest.mark.parametrize("order", ["long", "struct", "string", "timestamp"])
@pytest.mark.parametrize("layout", ["in order", "mixed"])
def test_decoding_by_any_layout(spark, batches, order, layout):
    rng = random.Random(batches)
    parts = [b"a", "é".encode(), "汉".encode(), "\U0001f600".encode(), b"\x80", b"\xc3", b"\xf0\x9f\x98", b"\xff", b"\xed\xa0\x80", b""]
    rows = []
    for k in (None, 1, 2, 3):
        whole, at = b"".join(rng.choice(parts if k != 3 else parts[:4]) for _ in range(50)), 0
        while at < len(whole):
            n = rng.randrange(1, 6)
            rows.append((k, at, whole[at : at + n], f"{k}-{at}"))
            at += n
    df = spark.createDataFrame(rows, "k int, off long, data binary, note string").coalesce(1)
    df = df if layout == "in order" else df.repartition(3)
    off = {"long": F.col("off"), "struct": F.struct(F.lit("x").alias("a"), "off"), "string": F.lpad(F.col("off").cast("string"), 6, "0"), "timestamp": F.timestamp_seconds("off")}[order]
    got = pieces.decode_utf8(df.withColumn("at", F.col("off")).withColumn("off", off), key="k")
    assert got.columns == ["k", "off", "note", "at", "text"] and got.schema["off"].dataType == df.select(off.alias("x")).schema["x"].dataType
    right = got.filter(F.col("off") == {"long": F.col("at"), "struct": F.struct(F.lit("x").alias("a"), F.col("at").alias("off")), "string": F.lpad(F.col("at").cast("string"), 6, "0"), "timestamp": F.timestamp_seconds("at")}[order])
    mine = {(r["k"], r["at"]): (r["text"], r["note"]) for r in right.collect()}
    assert len(mine) == len(rows) and all(mine[k, at][1] == note for k, at, _, note in rows)
    for k in (None, 1, 2, 3):
        data = [(at, p) for x, at, p, _ in rows if x == k]
        whole = b"".join(p for _, p in data)
        for at, p in data:  # what begins before a piece's end, without what begins before the piece
            upto = lambda n, whole=whole: next(whole[:m].decode("utf-8", "replace") for m in range(n, len(whole) + 1) if m == len(whole) or whole[:m].decode("utf-8", "replace") + whole[m:].decode("utf-8", "replace") == whole.decode("utf-8", "replace"))
            assert mine[k, at][0] == upto(at + len(p))[len(upto(at)) :], (k, at)
    together = {r["k"]: r["text"] for r in pieces.whole(got, key="k").collect()}
    assert together == {k: b"".join(p for x, _, p, _ in rows if x == k).decode("utf-8", "replace") for k in (None, 1, 2, 3)}


@pytest.mark.parametrize("layout", ["in order", "mixed"])
def test_lines_meet_by_runs(spark, monkeypatch, batches, layout):
    rng = random.Random(batches)
    wholes = {k: "".join(rng.choice(["x", "yy", "é", "\n", "\r", "\r\n"]) for _ in range(60)) for k in (None, 1, 2)} | {3: "\r\n", 4: "one"}
    rows = []
    for k, w in wholes.items():
        at = 0
        while at < len(w):
            n = rng.randrange(1, 4)
            rows.append((k, at, w[at : at + n]))
            at += n
    df = spark.createDataFrame(rows, "k int, off long, text string").coalesce(1)
    seen, meeting = [], pieces.meeting
    monkeypatch.setattr(pieces, "meeting", lambda met, *a, **k: (seen.append(met.count()), meeting(met, *a, **k))[1])
    got = sorted(map(str, map(tuple, pieces.lines(df if layout == "in order" else df.repartition(3), key="k").collect())))
    assert got == sorted(str((k, i, x)) for k, w in wholes.items() for i, x in enumerate(re.split("\r\n|\n|\r", w)))
    assert seen[0] < len(rows) / 2 and (batches == 7 or layout == "mixed" or seen == [5])


@pytest.mark.parametrize("by", [". ", "|", "||"])
def test_pieces_name_the_row_that_ends_them(spark, monkeypatch, batches, by):
    rng = random.Random(len(by) + batches)
    rows = [(rng.choice([1, 2, None]), i, "".join(rng.choice([by, by[:1], by[-1:], "é", "x"]) for _ in range(rng.randrange(4)))) for i in range(90)]
    rows.sort(key=lambda r: (r[0] or 0, r[1]))
    want = []
    for key in (None, 1, 2):
        whole = "".join(t for k, _, t in rows if k == key)
        ends = [i for k, i, t in rows if k == key for _ in t]  # the row of each character
        at, seen = 0, {}
        for piece in whole.split(by)[:-1]:
            at += len(piece) + len(by)
            row = ends[at - 1]
            want.append((key, row, seen.get(row, 0), piece))
            seen[row] = seen.get(row, 0) + 1
        if whole.split(by)[-1]:
            want.append((key, None, 0, whole.split(by)[-1]))
    seen, meeting = [], grouping.meeting
    monkeypatch.setattr(grouping, "meeting", lambda met, *a, **k: (seen.append(met.count()), meeting(met, *a, **k))[1])
    df = spark.createDataFrame(rows, "k int, seq long, text string").coalesce(1)
    got = grouping.resplit(df, by, key="k", number="n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert seen[0] == 3 or batches == 7
