"""Composed decoders over streams that are cut anywhere."""

import random

import pytest
from pyspark.errors import PythonException

from tidemark.functions import decoders as D

TEXT = D.then(D.uint(1), D.utf8)


def fed(stream, data, sizes):
    feed, out, at = D.Feed(stream), [], 0
    for n in sizes:
        out += feed.push(data[at : at + n])
        at += n
    return out + list(feed.push(data[at:], True)), feed.rest


def cuts(data):
    rng = random.Random(len(data))
    return [[], [1] * len(data), [len(data)], [0, 3, 0], [rng.randrange(4) for _ in data]]


def same(stream, data):
    got = [fed(stream, data, c) for c in cuts(data)]
    assert all(g == got[0] for g in got)
    return got[0]


def test_values():
    assert same(D.many(D.uint(2)), bytes(range(6))) == ([1, 0x203, 0x405], 0)
    assert same(D.many(D.sint(1, "little")), b"\xff\x01") == ([-1, 1], 0)
    assert same(D.many(TEXT), b"\x02hi\x00\x03\xe6\xb1\x89") == (["hi", "", "汉"], 0)
    assert same(D.once(D.uint(1)), b"\x05\x06") == ([5], 1) and same(D.once(D.uint(4), quiet=True), b"\x05")[0] == []
    assert same(D.many(D.repeat(2, D.uint(1))), b"\x01\x02\x03\x04") == ([[1, 2], [3, 4]], 0)


def test_ends_and_bad_values():
    for stream in (D.many(D.uint(2)), D.once(D.uint(4)), D.many(D.record(a=D.uint(1), b=D.uint(1)))):
        with pytest.raises(D.Incomplete):
            same(stream, b"abc")
    assert same(D.many(D.uint(2), quiet=True), b"abc")[0] == [0x6162]
    low = D.kept(D.uint(1), lambda v: v < 9)
    with pytest.raises(D.Bad, match="not accepted"):
        same(D.many(low), b"\x01\x09")
    assert same(D.many(low, quiet=True), b"\x01\x02\x09\x01")[0] == [1, 2]
    with pytest.raises(D.Bad):
        same(D.many(TEXT), b"\x01\xff")


def test_streams_of_streams():
    assert same(D.append(D.once(D.uint(1)), D.ignore(2), D.many(TEXT)), b"\x07??\x01a") == ([7, "a"], 0)
    assert same(D.append(D.emits([1, 2]), D.once(D.uint(1)), D.emits([3])), b"\x09") == ([1, 2, 9, 3], 0)
    # A value that says how many bytes of records follow it; what is left of them is passed over.
    framed = D.emitted(D.many(D.uint(1)), lambda n: D.isolate(n, D.many(D.uint(2), quiet=True)))
    assert same(framed, b"\x04\0\1\0\2\x03\0\3?\x00\x02\0\4") == ([1, 2, 3, 4], 0)
    assert same(D.emitted(D.many(D.uint(1)), lambda v: D.emits([v] * v)), b"\x02\x00\x01") == ([2, 2, 1], 0)
    with pytest.raises(D.Bad, match="stop"):
        same(D.emitted(D.many(D.uint(1)), lambda v: D.fail("stop") if v == 3 else D.emits([v])), b"\x01\x03")
    with pytest.raises(D.Incomplete):
        same(D.emitted(D.many(D.uint(2)), lambda v: D.emits([v])), b"\0\1\0")
    assert same(D.emitted(D.many(D.uint(2), quiet=True), lambda v: D.emits([v])), b"\0\1\0")[0] == [1]


def test_choices():
    frame = D.record(kind=D.uint(1), body=D.choice("kind", {0: TEXT, 1: D.record(n=D.uint(1), xs=D.after(lambda r: D.repeat(r["n"], D.uint(1))))}))
    assert same(D.many(frame), b"\x00\x01a\x01\x02\x05\x06") == ([{"kind": 0, "body": "a"}, {"kind": 1, "body": {"n": 2, "xs": [5, 6]}}], 0)
    with pytest.raises(D.Bad, match="no choice for 7"):
        same(D.many(frame), b"\x07")


def test_pieces(spark):
    rng = random.Random(4)
    stream = D.many(D.record(a=D.uint(1), t=TEXT))
    rows, want = [], []
    for k in ("x", "y", None):
        records = [(rng.randrange(256), "".join(rng.choice("aé汉") for _ in range(rng.randrange(9)))) for _ in range(50)]
        data = b"".join(bytes([a, len(t.encode())]) + t.encode() for a, t in records)
        want += [(k, n, a, t) for n, (a, t) in enumerate(records)]
        at = 0
        while at < len(data):
            n = rng.randrange(6)
            rows.append((k, at * 100 + len(rows), data[at : at + n] or None))
            at += n
    df = spark.createDataFrame(rows, "path string, off long, data binary").repartition(4)
    assert sorted(map(tuple, D.decode_pieces(df, stream, "a long, t string", strict=True).collect()), key=str) == sorted(want, key=str)
    with pytest.raises(PythonException, match="bytes are left"):
        D.decode_pieces(df, D.once(D.record(a=D.uint(1))), "a long", strict=True).collect()
    assert D.decode_pieces(df, D.once(D.record(a=D.uint(1))), "a long").count() == 3 and D.decode_pieces(df.limit(0), stream, "a long, t string").collect() == []
