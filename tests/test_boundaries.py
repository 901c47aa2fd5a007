"""Groups and machines in parallel against a walk over lists."""

import random

import pytest

from tidemark.operators import automata, boundaries


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(boundaries, "BLOCK", 7)


def timed(seed, n, keys=1):
    rng, out, at = random.Random(seed), [], [0] * keys
    for k in range(n):
        key = 0 if rng.random() < 0.6 else rng.randrange(keys)  # one key holds most rows
        at[key] += rng.choice([0, 0, 1, 2, 3, 9, 40])
        out.append((k, key, at[key]))
    return out


def walk_groups(rows, size, wait):
    out, n, begun, group = [], 0, None, -1
    for seq, _, t in rows:
        if begun is None or n >= size or t >= begun + wait:
            group, n, begun = group + 1, 0, t
        n += 1
        out.append((seq, group))
    return out


@pytest.mark.parametrize("size,wait", [(3, 10**9), (4, 12), (50, 300)])
def test_group_within(spark, small, size, wait):
    rows = timed(size, 200)
    df = spark.createDataFrame(rows, "seq long, user long, us long").repartition(5)
    got = sorted((r["seq"], r["group"]) for r in boundaries.group_within(df, size, wait).collect())
    assert got == sorted(walk_groups(rows, size, wait))
    rows = timed(size, 200, keys=4)
    df = spark.createDataFrame(rows, "seq long, user long, us long").repartition(5)
    want = [x for k in range(4) for x in walk_groups([r for r in rows if r[1] == k], size, wait)]
    assert sorted((r["seq"], r["group"]) for r in boundaries.group_within(df, size, wait, key="user").collect()) == sorted(want)


@pytest.mark.parametrize("wait", [7, 10**9])
def test_debounce(spark, small, wait):
    def walk(rows):
        groups = walk_groups(rows, 10**9, wait)
        return [max(s for s, g in groups if g == n) for n in {g for _, g in groups}]

    rows = timed(wait, 150, keys=3)
    df = spark.createDataFrame(rows, "seq long, user long, us long").repartition(5)
    assert sorted(r["seq"] for r in boundaries.debounce(df, wait, key="user").collect()) == sorted(x for k in range(3) for x in walk([r for r in rows if r[1] == k]))
    single = sorted(((s, 0, t) for s, _, t in rows), key=lambda r: (r[2], r[0]))
    assert sorted(r["seq"] for r in boundaries.debounce(df, wait).collect()) == sorted((lambda order: [order[max(i for i, (s, g) in enumerate(walk_groups(order, 10**9, wait)) if g == n)][0] for n in {g for _, g in walk_groups(order, 10**9, wait)}])(single))
    assert boundaries.debounce(df.limit(0), wait).collect() == [] and boundaries.debounce(df.filter("seq = 3"), wait).count() == 1


def test_debounce_example(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 500, 4), (4, 500, 5), (5, 510, 6)], "seq long, us long, v long")
    assert sorted(r["v"] for r in boundaries.debounce(df, 100).collect()) == [3, 6]


@pytest.mark.parametrize("least,partial", [(5, True), (5, False), (1000, True)])
def test_chunk_min(spark, small, least, partial):
    rng = random.Random(least)
    chunks = [(k, rng.choice([0, 1, 1, 2, 7])) for k in range(120)]
    want, held, n, group = [], [], 0, 0
    for c in chunks:
        held.append((c[0], group))
        n += c[1]
        if n >= least:
            want, held, n, group = want + held, [], 0, group + 1
    want += held if partial else []
    df = spark.createDataFrame(chunks, "chunk long, n long").repartition(4)
    assert sorted((r["chunk"], r["group"]) for r in boundaries.chunk_min(df, least, partial).collect()) == want


TURNSTILE = automata.Machine(("locked", "open", "broken"), {("locked", "coin"): ("open", "thanks"), ("open", "push"): ("locked", None), ("locked", "push"): ("locked", "no"), ("open", "kick"): ("broken", "ouch")}, "locked")


@pytest.mark.parametrize("key", [None, "user"])
@pytest.mark.parametrize("block,fan", [(3, 2), (1000, 10)])
def test_machine(spark, key, block, fan):
    rng = random.Random(block)
    rows = [(k, 0 if rng.random() < 0.7 else rng.randrange(4), rng.choice(["coin", "push", "push", "kick" if k > 80 else "coin", "other", None])) for k in range(100)]
    held, want = {}, []
    for seq, user, symbol in rows:
        state = held.get(user if key else 0, "locked")
        after, out = TURNSTILE.steps.get((state, symbol), (state, None))
        held[user if key else 0] = after
        want.append((seq, after, out))
    df = spark.createDataFrame(rows, "seq long, user long, symbol string").repartition(4)
    got = automata.run(df, TURNSTILE, df["symbol"], key=key, block=block, fan=fan)
    assert sorted((r["seq"], r["state"], r["output"]) for r in got.collect()) == want
    assert automata.run(df.limit(0), TURNSTILE, df["symbol"], key=key).collect() == []
