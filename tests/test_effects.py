"""Positions over several partitions, failures, pacing and pauses, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import grouping, outcomes, pacing, pairing, scans, selection
from tidemark.operators.ordered import running, with_index


def frame(spark, rows, schema="seq long, value double"):
    return spark.createDataFrame(rows, schema)


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_hold_over_several_partitions(spark, adaptive):
    n = 60_000
    wide = spark.range(n).select((F.col("id") * 7919 % n).alias("seq"), F.sha2(F.col("id").cast("string"), 512).alias("pad")).repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
        placed = with_index(wide).agg(F.count("*").alias("n"), F.count_if(F.col("idx") != F.col("seq")).alias("wrong"), F.max("pad")).first()
        assert (placed["n"], placed["wrong"]) == (n, 0)
        summed = running(wide, F.col("seq"), "s").agg(F.count_if(F.col("s") != F.col("seq") * (F.col("seq") + 1) / 2).alias("wrong"), F.count("*").alias("n"), F.max("pad")).first()
        assert (summed["n"], summed["wrong"]) == (n, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_failures(spark):
    df = frame(spark, [(1, 1.0), (2, None), (3, 9.0), (4, 2.0)])
    bad = F.when(F.col("value") > 5, "big")
    assert pairs(outcomes.attempt(df, F.col("value"), bad).fillna({"error": "", "result": -1.0}), "seq", "result", "error") == [(1, 1.0, ""), (2, -1.0, ""), (3, -1.0, "big")]
    assert pairs(outcomes.mask(df, bad), "seq") == [(1,), (2,)]
    assert pairs(outcomes.handle_error_with(df, bad, df.filter("seq = 4")), "part", "seq") == [(0, 1), (0, 2), (1, 4)]
    assert pairs(outcomes.handle_error_with(df, F.lit(None), df), "part", "seq") == [(0, k) for k in (1, 2, 3, 4)]
    assert outcomes.attempt(df.limit(0), F.col("value"), bad).count() == 0
    assert outcomes.ensure(df.filter("seq <> 2"), F.col("value") < 10, "too big").count() == 3
    for broken in (outcomes.ensure(df, F.col("value") < 10, "too big"), outcomes.rethrow(df.withColumn("error", bad)), outcomes.only_or_error(df), outcomes.only_or_error(df.limit(0))):
        with pytest.raises(Exception):
            broken.collect()
    assert outcomes.only_or_error(df.filter("seq = 1")).collect()[0]["value"] == 1.0


def test_retry():
    calls, pauses = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert outcomes.retry(action, 5, 0.0, lambda d: pauses.append(d) or d) == "done"
    assert len(calls) == 3 and len(pauses) == 2
    with pytest.raises(OSError):
        outcomes.retry(lambda: (_ for _ in ()).throw(OSError("x")), 2)
    tried = []
    with pytest.raises(ValueError):
        outcomes.retry(lambda: tried.append(1) or int("x"), 3, retriable=lambda e: False)
    assert len(tried) == 1


def test_eval(spark):
    df = frame(spark, [(1, 1.0), (2, 4.0)])
    assert pairs(outcomes.eval_map(df, "value", lambda v: v + 1, "double", "made"), "seq", "made") == [(1, 2.0), (2, 5.0)]
    assert pairs(outcomes.eval_filter(df, "value", lambda v: v > 2), "seq") == [(2,)]


def test_pacing(spark):
    df = frame(spark, [(1, 0), (2, 1), (3, 7)], "seq long, us long").select("seq", F.timestamp_micros("us").alias("ts"))
    assert pairs(pacing.metered(df, 10), "seq", "emit_us") == [(1, 10), (2, 20), (3, 30)]
    assert pairs(pacing.keep_alive(df, 3), "us", "beat") == [(0, False), (1, False), (4, True), (7, False)]
    assert pairs(pacing.interrupt_after(df, 7), "seq") == [(1,), (2,)]
    assert pacing.timeout(df, 7).count() == 3
    with pytest.raises(Exception):
        pacing.timeout(df, 6).collect()
    control = frame(spark, [(2, False), (3, True)], "seq long, flag boolean")
    assert pairs(pacing.interrupt_when(df, control, F.col("flag")), "seq") == [(1,), (2,)]
    assert pacing.interrupt_when(df, control.limit(0), F.col("flag")).count() == 3


def test_pause(spark):
    df = frame(spark, [(1, 0.0), (3, 0.0), (4, 0.0), (7, 0.0), (9, 0.0)])
    control = frame(spark, [(2, True), (5, False), (8, True)], "seq long, flag boolean")
    rows = pacing.pause_when(df, control, "flag").orderBy("seq").collect()
    assert [(r["seq"], r["paused"], r["release"]) for r in rows] == [(1, False, 1), (3, True, 5), (4, True, 5), (7, False, 7), (9, True, None)]


def test_held_values(spark):
    df = frame(spark, [(1, None), (2, 5.0), (3, None), (4, 7.0)])
    assert pairs(pacing.hold(df, F.col("value"), 0.0), "seq", "held") == [(1, 0.0), (2, 5.0), (3, 5.0), (4, 7.0)]
    assert pairs(pacing.hold1(df, F.col("value")), "seq", "held") == [(2, 5.0), (3, 5.0), (4, 7.0)]


def test_switch_map_without_key(spark):
    outer, inner = frame(spark, [(2, 1.0), (5, None)]), frame(spark, [(1, 0.0), (3, 0.0), (5, 0.0), (6, 0.0)])
    assert pairs(pairing.switch_map(outer, inner).select("seq", F.col("outer.seq").alias("o")), "seq", "o") == [(3, 2), (5, 5), (6, 5)]


def test_chunks(spark):
    machine = scans.ChunkMin(4)
    state, out = machine.start(), []
    for c, n in enumerate([1, 2, 3, 5, 1]):
        state, rows = machine.step(state, type("R", (tuple,), {"n": n})((c, n)))
        out += rows
    out += machine.finish(state)
    assert out == [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 5, 1), (4, 1, 2)]
    df = frame(spark, [(k, float(k)) for k in range(500)])
    a, b = (grouping.rechunk_randomly(x, 7, 10) for x in (df, df.repartition(5)))
    assert pairs(a, "seq", "chunk") == pairs(b, "seq", "chunk") and 20 < a.agg(F.max("chunk")).first()[0] < 100
    assert pairs(selection.cons(df.limit(0), {"value": 1.0}), "seq", "value") == [(0, 1.0)]
    assert selection.drop_last(df.limit(0)).count() == 0


def test_arrays(spark):
    row = spark.range(1).select(F.array(*map(F.lit, (1, 2, 3))).alias("a"))
    a = F.col("a")
    got = row.select(*arrays.split_at(a, 2), arrays.starts_with(a, F.array(F.lit(1))), arrays.map_filter(a, lambda x: F.when(x > 1, x * 10)), arrays.map_accumulate(a, F.lit(0), lambda s, x: s + x)).first()
    assert tuple(got) == ([1, 2], [3], True, [20, 30], [1, 3, 6])
    carried = row.select(arrays.scan_left_carry(a, F.lit(0), lambda s, x: s + x).alias("r")).first()["r"]
    assert (carried["states"], carried["carry"]) == ([0, 1, 3], 6)
