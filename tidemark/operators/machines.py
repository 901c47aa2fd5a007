"""Machines made of machines: stages in a row, sides, parts of a row. All run by scans.run and scans.run_stream like any other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemark.operators.scans import Scan


@dataclass
class Stateful(Scan):
    """rule(state, row) -> (state, rows); end(state) -> rows."""

    initial: object
    rule: Callable
    end: Callable = lambda state: []

    def start(self):
        return self.initial

    def step(self, state, row):
        return self.rule(state, row)

    def finish(self, state):
        return self.end(state)


def lift(f: Callable) -> Scan:
    """A row for each row."""
    return Stateful(None, lambda state, row: (state, [f(row)]))


def stateless(f: Callable) -> Scan:
    """Any number of rows for each row."""
    return Stateful(None, lambda state, row: (state, list(f(row))))


@dataclass
class AndThen(Scan):
    """What the first machine puts out is the second one's input, also what it puts out at the end."""

    first: Scan
    second: Scan

    def start(self):
        return self.first.start(), self.second.start()

    def _feed(self, state, rows):
        out = []
        for row in rows:
            state, made = self.second.step(state, row)
            out += made
        return state, out

    def step(self, state, row):
        a, rows = self.first.step(state[0], row)
        b, out = self._feed(state[1], rows)
        return (a, b), out

    def finish(self, state):
        b, out = self._feed(state[1], self.first.finish(state[0]))
        return out + self.second.finish(b)


@dataclass
class Dimap(Scan):
    """before(row) goes in, after(row) of what comes out."""

    inner: Scan
    before: Callable = lambda row: row
    after: Callable = lambda row: row

    def start(self):
        return self.inner.start()

    def step(self, state, row):
        state, rows = self.inner.step(state, self.before(row))
        return state, [self.after(r) for r in rows]

    def finish(self, state):
        return [self.after(r) for r in self.inner.finish(state)]


def contramap(inner: Scan, before: Callable) -> Scan:
    return Dimap(inner, before=before)


@dataclass
class Semilens(Scan):
    """split(row) is (True, part) for the machine, whose rows put(row, made) back, or (False, row) to pass. At the end there is no row to put back into: nothing comes out."""

    inner: Scan
    split: Callable
    put: Callable

    def start(self):
        return self.inner.start()

    def step(self, state, row):
        mine, part = self.split(row)
        if not mine:
            return state, [part]
        state, rows = self.inner.step(state, part)
        return state, [self.put(row, r) for r in rows]


def lens(inner: Scan, get: Callable, put: Callable) -> Scan:
    return Semilens(inner, lambda row: (True, get(row)), put)


def on(inner: Scan, at: int) -> Scan:
    """The machine works on the field at that place (as a row of one) and the others stay: first is 0, second 1."""
    return lens(inner, lambda row: (row[at],), lambda row, made: (*row[:at], made[0], *row[at + 1 :]))


def semipass(inner: Scan, split: Callable) -> Scan:
    return Semilens(inner, split, lambda row, made: made)


@dataclass
class Choice(Scan):
    """Rows that the test picks go through the left machine, others through the right one."""

    test: Callable
    left: Scan
    right: Scan

    def start(self):
        return self.left.start(), self.right.start()

    def step(self, state, row):
        if self.test(row):
            s, rows = self.left.step(state[0], row)
            return (s, state[1]), rows
        s, rows = self.right.step(state[1], row)
        return (state[0], s), rows

    def finish(self, state):
        return self.left.finish(state[0]) + self.right.finish(state[1])


def left(inner: Scan, test: Callable) -> Scan:
    """Only rows that the test picks go through the machine; others pass."""
    return Choice(test, inner, lift(tuple))


def right(inner: Scan, test: Callable) -> Scan:
    return Choice(test, lift(tuple), inner)
