"""Checksums of sequences against those of their bytes, and calls in flight."""

import asyncio
import hashlib
import random
import threading
import time
import zlib

import pytest
from pyspark.errors import PythonException

from tidemark.functions import combining
from tidemark.functions.hashing import Crc
from tidemark.operators import concurrent, ordered


@pytest.mark.parametrize("kind", ["crc32", "crc32c", "crc16", "crc64", (0x07, 0x55, False, 0x11, 8)])
def test_crc_of_a_sequence(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, None]), i, rng.choice([None, b"", rng.randbytes(rng.randrange(3000))])) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, seq long, data binary").repartition(3)
    spec = combining.KINDS[kind] if isinstance(kind, str) else kind
    of = lambda parts: Crc(*spec).of([b"".join(x or b"" for x in parts)])[0]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    got = {r["k"]: (r["n_bytes"], r["crc"]) for r in combining.crc_sequence(df, "data", kind, key="k").collect()}
    for k in (1, 2, None):
        own = [x for key, _, x in rows if key == k]
        assert got[k] == (sum(len(x or b"") for x in own), signed(of(own)))
    whole = combining.crc_sequence(df, "data", kind).first()
    assert whole["crc"] == signed(of([x for *_, x in rows]))
    if kind == "crc32":
        assert whole["crc"] == zlib.crc32(b"".join(x or b"" for *_, x in rows))
    assert combining.crc_sequence(df.limit(0), "data", kind).first()["crc"] == signed(of([]))
    assert combining.crc_sequence(df.limit(0), "data", kind, key="k").collect() == []


def test_digest_of_a_sequence(spark):
    rows = [(k, i, bytes([i, k or 0]) if i % 3 else None) for i in range(30) for k in (1, 2, None)]
    df = spark.createDataFrame(rows, "k long, seq long, data binary").repartition(4)
    want = {k: hashlib.sha256(b"".join(x or b"" for key, _, x in rows if key == k)).hexdigest() for k in (1, 2, None)}
    assert {r["k"]: r["digest"] for r in combining.digest_sequence(df, "data", key="k").collect()} == want
    assert combining.digest_sequence(df.filter("k = 1"), "data", "md5").first()["digest"] == hashlib.md5(b"".join(x or b"" for k, _, x in rows if k == 1)).hexdigest()
    passed = combining.with_digest(df.filter("k is not null"), "data", key="k").orderBy("k", "part", "seq").collect()
    assert [r["seq"] for r in passed] == [*range(30), None] * 2 and [bytes(r["data"]).hex() for r in passed if r["part"]] == [want[1], want[2]]


def calls(f):
    """f, counting how many calls run at once and how many begin."""
    lock, seen = threading.Lock(), {"now": 0, "most": 0, "begun": 0}

    def g(x):
        with lock:
            seen["now"] += 1
            seen["begun"] += 1
            seen["most"] = max(seen["most"], seen["now"])
        try:
            return f(x)
        finally:
            with lock:
                seen["now"] -= 1

    return g, seen


@pytest.mark.parametrize("most", [1, 3, 8])
def test_bound_and_order(most):
    f, seen = calls(lambda x: (time.sleep(0.05 if x < 8 else 0.002 * (x % 5)), x * x)[1])
    assert list(concurrent.window(iter(range(60)), f, most)) == [(k, k * k) for k in range(60)]
    assert seen["most"] == most
    f, seen = calls(lambda x: (time.sleep(0.05 if x == 0 else 0.001), x)[1])
    got = list(concurrent.window(iter(range(40)), f, most, ordered=False))
    assert sorted(got) == [(k, k) for k in range(40)] and seen["most"] <= most and (most == 1 or got[0] != (0, 0))


@pytest.mark.parametrize("ordered_", [True, False])
def test_first_failure_cancels(ordered_):
    def f(x):
        if x == 5:
            raise RuntimeError("five")
        time.sleep(0.01)
        return x

    g, seen = calls(f)
    with pytest.raises(RuntimeError, match="five"):
        list(concurrent.window(iter(range(1000)), g, 4, ordered_))
    assert seen["begun"] < 30  # the source was not read on


@pytest.mark.parametrize("ordered_", [True, False])
def test_coroutines(ordered_):
    seen = {"now": 0, "most": 0, "cancelled": 0}

    async def f(x):
        seen["now"] += 1
        seen["most"] = max(seen["most"], seen["now"])
        try:
            await asyncio.sleep(0.002 * (x % 4))
            if x == 90:
                raise RuntimeError("ninety")
            return -x
        except asyncio.CancelledError:
            seen["cancelled"] += 1
            raise
        finally:
            seen["now"] -= 1

    got = list(concurrent.window(iter(range(40)), f, 6, ordered_))
    assert (got if ordered_ else sorted(got)) == [(k, -k) for k in range(40)] and seen["most"] == 6
    with pytest.raises(RuntimeError, match="ninety"):
        list(concurrent.window(iter(range(80, 200)), f, 6, ordered_))
    assert seen["now"] == 0


@pytest.mark.parametrize("ordered_", [True, False])
def test_rows_keep_their_columns(spark, ordered_):
    df = spark.range(2500).selectExpr("id", "id * 2 AS twice", "CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS v").repartition(3)
    got = concurrent.par_eval_map(df, "v", lambda v: None if v is None else [v, v + 1], "array<long>", "made", 8, ordered_).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, 2 * k, None if k % 7 == 0 else k, None if k % 7 == 0 else [k, k + 1]) for k in range(2500)), key=str)
    with pytest.raises(PythonException, match="ZeroDivision"):
        concurrent.par_eval_map(df, "id", lambda v: 1 / (v - 9), "double", "made", 4, ordered_).collect()
