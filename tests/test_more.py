"""Local reordering against a buffer in plain Python, effects, ends of sequences, and rows after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import folding, grouping, outcomes, pairing, selection, timeseries


def buffered(rows, over):
    """The rule by the book: a sorted buffer, from which rows leave once the maximum is `over` beyond them."""
    held, out, top = [], [], None
    for seq, us in rows:
        held.append((us, seq))
        top = us if top is None else max(top, us)
        held.sort()
        while held and held[0][0] <= top - over:
            out.append(held.pop(0)[1])
    return out + [seq for _, seq in held]


@pytest.mark.parametrize("over", [0, 1, 7, 30, 1000])
def test_local_reordering_is_the_buffer(spark, over):
    rng = random.Random(over)
    rows = [(i, i * 3 + rng.choice([0, 0, 0, -20, 15, -60])) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, us long").select("seq", F.timestamp_micros("us").alias("ts"))
    got = [r.seq for r in timeseries.attempt_reorder_locally(df, over).orderBy("pos").collect()]
    assert got == (buffered(rows, over) if over else [seq for seq, _ in rows])
    assert timeseries.attempt_reorder_locally(df.limit(0), over).count() == 0


@pytest.mark.parametrize("n", [-1, 0, 1, 3, 9])
def test_ends_by_passes_and_by_positions(spark, monkeypatch, n):
    df = spark.createDataFrame([(3,), (1,), (7,), (5,)], "seq long")
    rows = sorted(r.seq for r in df.collect())
    for near in (10_000, 0):
        monkeypatch.setattr(selection, "NEAR_END", near)
        assert sorted(r.seq for r in selection.drop(df, n).collect()) == rows[max(n, 0) :]
        assert sorted(r.seq for r in selection.drop_right(df, n).collect()) == rows[: max(len(rows) - max(n, 0), 0)]
        assert sorted(r.seq for r in selection.uncons_n(df, n).filter("in_head").collect()) == rows[: max(n, 0)]
        assert selection.drop(df.limit(0), n).count() == selection.drop_right(df.limit(0), n).count() == 0


def test_effects_run_and_fail(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "seq long, value double")
    assert outcomes.eval_tap(df, "value", lambda v: None).count() == 3

    def picky(v):
        if v == 9.0:
            raise ValueError("nine")

    with pytest.raises(Exception, match="nine"):
        outcomes.eval_tap(df, "value", picky).collect()
    assert [r.seq for r in outcomes.eval_filter_not(df.filter("value is not null"), "value", lambda v: v > 6).collect()] == [1]


def test_rows_after_a_failure(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, v string")
    other = df.filter("seq = 1")
    told = lambda error: sorted((r.part, r.seq, r.failed) for r in outcomes.on_complete(df, error, other).collect())
    assert told(F.when(F.col("seq") == 2, "bad")) == [(0, 1, None), (1, 1, None), (2, 2, "bad")]
    assert told(F.lit(None)) == [(0, 1, None), (0, 2, None), (0, 3, None), (1, 1, None)]
    with pytest.raises(Exception, match="bad"):
        outcomes.from_either(spark.createDataFrame([("bad", None)], "l string, r long"), "l", "r").collect()


def test_lists_signals_and_arrays(spark):
    df = spark.createDataFrame([(2, "k", "b"), (1, "k", "a"), (3, "m", None)], "seq long, k string, v string")
    assert sorted((r.k, r.text) for r in folding.compiled_string(df, F.col("v"), "k").collect()) == [("k", "ab"), ("m", "")]
    assert sorted((r.part, r.seq) for r in pairing.get_and_updates(df, 2).collect()) == [(0, 2), (1, 3)]
    one = lambda c: spark.range(1).select(c).first()[0]
    a = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert one(arrays.traverse(a, lambda x: F.when(x < 3, x))) is None
    assert one(arrays.collect_while(a, lambda x: F.when(x < 3, x * 2))) == [2, 4]
    assert one(arrays.take_exactly(a, 4)) is None
    assert one(arrays.from_option(F.lit(None).cast("int"))) == []
    assert one(arrays.constant(F.lit(7), -1)) == []


def test_random_chunks_depend_on_seed_and_order_only(spark):
    df = spark.range(500).select(F.col("id").alias("seq"))
    chunks = lambda d, seed: {r.seq: r.chunk for r in grouping.rechunk_randomly(d, seed, 16).collect()}
    assert chunks(df, 1) == chunks(df.repartition(7), 1) != chunks(df, 2)
