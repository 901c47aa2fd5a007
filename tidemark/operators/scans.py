"""State machines for rules that look at what they last did: run per key in batch, and on streams by the same object.

A machine has start(), step(state, row) -> (state, rows), and finish(state) -> rows. State is any picklable value, rows are tuples.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


class Scan:
    def start(self):
        return None

    def step(self, state, row):
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        return []


@dataclass
class FilterWithPrevious(Scan):
    """Keeps rows that a test of (last kept value, value) lets through; the first always."""

    test: object
    value: str = "value"

    def step(self, state, row):
        v = getattr(row, self.value)
        return (state, []) if state is not None and not self.test(state[0], v) else ((v,), [tuple(row)])


@dataclass
class Debounce(Scan):
    """The last row of each span: a span opens with a row and lasts `wait` microseconds of event time."""

    wait: int
    time: str = "us"

    def step(self, state, row):
        t = getattr(row, self.time)
        if state is None or t >= state[0] + self.wait:
            return (t, tuple(row)), [] if state is None else [state[1]]
        return (state[0], tuple(row)), []

    def finish(self, state):
        return [] if state is None else [state[1]]


@dataclass
class GroupWithin(Scan):
    """Numbers groups that close after `size` rows or `wait` microseconds after their first; rows get (group,)."""

    size: int
    wait: int
    time: str = "us"

    def step(self, state, row):
        t = getattr(row, self.time)
        group, n, begun = state or (0, 0, t)
        if n and (n >= self.size or t >= begun + self.wait):
            group, n, begun = group + 1, 0, t
        return (group, n + 1, begun if n else t), [(*row, group)]


@dataclass
class Resplit(Scan):
    """Joins what is left of the row before to each text and splits it again; the last piece is carried."""

    by: str
    value: str = "text"

    def step(self, state, row):
        *done, rest = ((state or "") + (getattr(row, self.value) or "")).split(self.by)
        return rest, [(row.seq, k, piece) for k, piece in enumerate(done)]

    def finish(self, state):
        return [(None, 0, state)] if state else []


@dataclass
class Accumulate(Scan):
    """step_of(state, row) gives (state, output); rows get both. With seed_row, the first state goes out before any row, whose columns are null then."""

    first: object
    step_of: object
    width: int
    seed_row: bool = False

    def start(self):
        return self.first, self.seed_row

    def step(self, state, row):
        held, begin = state
        seed = [(*[None] * self.width, held, None)] if begin else []
        held, out = self.step_of(held, row)
        return (held, False), [*seed, (*row, held, out)]


@dataclass
class ChunkMin(Scan):
    """Joins whole chunks, given as rows of (chunk, n), until a group has `least` rows; rows get (group,). A short last group stays only if partial."""

    least: int
    partial: bool = True

    def start(self):
        return 0, 0, []

    def step(self, state, row):
        group, n, held = state
        n, held = n + row.n, [*held, (*row, group)]
        return ((group + 1, 0, []), held) if n >= self.least else ((group, n, held), [])

    def finish(self, state):
        return state[2] if self.partial else []


def run(df: DataFrame, machine: Scan, schema: str, key: str, order: str = "seq") -> DataFrame:
    """Rows of each key in order through the machine. A key's rows are together in one task, as its state is sequential."""
    cols = [c for c in df.columns if c != key]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        state, out = machine.start(), []
        for row in part.sort_values(order, kind="stable")[cols].itertuples(index=False):
            state, rows = machine.step(state, row)
            out += rows
        out += machine.finish(state)
        made = pd.DataFrame(out, columns=[n for n in names if n != key])
        made[key] = part[key].iloc[0]
        return made[names]

    return df.groupBy(key).applyInPandas(work, schema)


def run_stream(df: DataFrame, machine: Scan, schema: str, key: str, order: str = "seq") -> DataFrame:
    """The same machine on a stream: state is kept per key between micro-batches, rows within one are put in order."""
    cols = [c for c in df.columns if c != key]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def work(k, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else machine.start()
        out = []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable")[cols].itertuples(index=False):
            state, rows = machine.step(state, row)
            out += rows
        held.update((pickle.dumps(state),))
        made = pd.DataFrame(out, columns=[n for n in names if n != key])
        made[key] = k[0]
        yield made[names]

    return df.groupBy(key).applyInPandasWithState(work, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
