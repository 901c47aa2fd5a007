"""Operators of streams that act when time passes, not only when rows come: event-time timers on keyed state.

A machine of this module has due(state), the time (in microseconds) at which it acts by itself or None, and ring(state) -> (state, rows) for acting, besides start() and step(state, row). Rows wait in list state until the watermark has passed them and then go through the machine in the order of time and seq, with what is due between them. So the result doesn't depend on how rows were dealt into micro-batches, and equals that of the batch form over all rows that the watermark has passed. What is due with no further row comes out by a timer. State is a key's waiting rows and one pickled value.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession):
    """Timers need a state store that can be read by ranges; a stream that is started inside uses one, and the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Timed:
    """A machine that never acts by itself."""

    def start(self):
        return None

    def due(self, state) -> int | None:
        return None

    def ring(self, state) -> tuple[object, list[tuple]]:
        return state, []


@dataclass
class Debounce(Timed):
    """The last row of each span: a span opens with a row and lasts `wait`; its last row is out as soon as that time has passed."""

    wait: int

    def step(self, state, row):
        return (row[0] if state is None else state[0], row), []

    def due(self, state):
        return None if state is None else state[0] + self.wait

    def ring(self, state):
        return None, [state[1]]


@dataclass
class GroupWithin(Timed):
    """Numbers groups that close after `size` rows or `wait` after their first; a group's rows are out together when it closes, with its number."""

    size: int
    wait: int

    def start(self):
        return 0, []

    def step(self, state, row):
        number, held = state
        held = [*held, row]
        return ((number + 1, []), [(*r, number) for r in held]) if len(held) >= self.size else ((number, held), [])

    def due(self, state):
        return state[1][0][0] + self.wait if state[1] else None

    def ring(self, state):
        return (state[0] + 1, []), [(*r, state[0]) for r in state[1]]


@dataclass
class Timeout(Timed):
    """Says when no row has come for `wait`: the last row before, and the time at which the wait was over. Once for each such gap."""

    wait: int

    def step(self, state, row):
        return row, []

    def due(self, state):
        return None if state is None else state[0] + self.wait

    def ring(self, state):
        return None, [(*state, state[0] + self.wait)]


class Replay(StatefulProcessor):
    """Runs a machine over the rows of a key as the watermark passes them. Rows are tuples of (us, seq, other columns)."""

    def __init__(self, machine: Timed, key: str, columns: list[str], names: list[str]):
        self.machine, self.key, self.columns, self.names = machine, key, columns, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state binary")
        self.waiting = handle.getListState("waiting", "us long, row binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for part in rows for r in part[self.columns].itertuples(index=False, name=None)]
        yield self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.alarm.clear()
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: list[tuple], now: int) -> pd.DataFrame:
        state = pickle.loads(self.held.get()[0]) if self.held.exists() else self.machine.start()
        rows = sorted([pickle.loads(r) for _, r in self.waiting.get()] + new, key=lambda r: r[:2])
        passed = sum(r[0] <= now for r in rows)
        out: list[tuple] = []
        for row in rows[:passed]:
            state = self._ring(state, row[0], out)
            state, made = self.machine.step(state, row)
            out += made
        state = self._ring(state, now, out)
        self.held.update((pickle.dumps(state),))
        self.waiting.clear()
        if rows[passed:]:
            self.waiting.put([(r[0], pickle.dumps(r)) for r in rows[passed:]])
        due = self.machine.due(state)
        self._set_alarm(min((t for t in (due, rows[passed][0] if rows[passed:] else None) if t is not None), default=None))
        made = pd.DataFrame(out, columns=[n for n in self.names if n != self.key])
        made[self.key] = key[0]
        return made[self.names]

    def _ring(self, state, now: int, out: list[tuple]):
        while (at := self.machine.due(state)) is not None and at <= now:
            state, made = self.machine.ring(state)
            out += made
        return state

    def _set_alarm(self, us: int | None) -> None:
        """One timer a key: the next time at which there is something to do."""
        at = None if us is None else -(-us // 1000)
        before = self.alarm.get()[0] if self.alarm.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def close(self) -> None:
        pass


def replayed(df: DataFrame, machine: Timed, schema: str, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """df, a stream with columns ts (its event time), us, seq and others, through the machine for each key. schema: the rows that come out, the key among them; other columns stand in the order us, seq, others."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    columns = ["us", "seq", *[c for c in df.columns if c not in (ts, "us", "seq", key)]]
    return df.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(Replay(machine, key, columns, names), schema, "Append", "eventTime")
