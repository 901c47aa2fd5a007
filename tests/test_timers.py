"""Timed operators of streams: the same rows however they are dealt into micro-batches, and out without a further row."""

import random

import pytest

from tidemark.streaming import timers


def streamed(spark, tmp_path, parts, machine, schema):
    """Rows (us, seq, user) in files that come one a batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "us long, seq long, user long").selectExpr("*", "timestamp_micros(us) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("us long, seq long, user long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    made = timers.replayed(source, machine, schema, "user", late="1 hour")
    before = spark.conf.get(timers.PROVIDER, None)
    with timers.timed_state(spark):
        q = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    assert spark.conf.get(timers.PROVIDER, None) == before
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))


SECOND = 1_000_000
SCHEMA = "user long, us long, seq long"


def walked(rows, machine, end):
    """The machine over each user's rows up to `end`, as timers would drive it."""
    out = []
    for user in {r[2] for r in rows}:
        state = machine.start()
        for row in [*sorted(r[:2] for r in rows if r[2] == user and r[0] <= end), (end, None)]:
            while (at := machine.due(state)) is not None and at <= row[0]:
                state, made = machine.ring(state)
                out += [(user, *m) for m in made]
            if row[1] is not None:
                state, made = machine.step(state, row)
                out += [(user, *m) for m in made]
    return sorted(out)


@pytest.mark.parametrize("machine,schema", [(timers.Debounce(30 * SECOND), SCHEMA), (timers.GroupWithin(3, 40 * SECOND), f"{SCHEMA}, number long"), (timers.Timeout(25 * SECOND), f"{SCHEMA}, at long")])
def test_batches_change_nothing(spark, tmp_path, machine, schema):
    rng = random.Random(1)
    rows = [(rng.randrange(600) * SECOND + k * 1000, k, 0 if rng.random() < 0.7 else 1) for k in range(60)]
    rows.append((7200 * SECOND, 99, 2))  # lets the watermark pass all the others
    rng.shuffle(rows)  # out of order within the hour that the watermark waits
    rows.sort(key=lambda r: r[1] == 99)
    want = walked(rows, machine, 3600 * SECOND)
    assert streamed(spark, tmp_path / "one", [rows], machine, schema) == want
    assert streamed(spark, tmp_path / "four", [rows[:20], rows[20:35], rows[35:50], rows[50:]], machine, schema) == want
    assert want
