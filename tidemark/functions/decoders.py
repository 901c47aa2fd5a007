"""Decoders of binary streams that are made of smaller ones, run over streams in pieces.

A decoder is a generator: it yields how many bytes it needs, gets just those, and returns a value; decoders are put together by `yield from`. A stream decoder besides yields Emit(value) for what goes out. What a record that lies across pieces has got so far is held by the suspended generator, so pieces may be cut anywhere and nothing is read twice.

decode_pieces() runs a stream decoder over the pieces of each key in order: keys are dealt to tasks and sorted, batches of pieces go through, rows come out. A key is read by one task, as only the bytes before say where a record begins; a task holds a batch, the bytes that a decoder waits for, and at most TOGETHER rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Generator, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are sent on together.
TOGETHER = 1000
#: What a decoder yields to ask whether the stream is at its end.
AT_END = -1
Decoder = Callable[[], Generator]


class Incomplete(Exception):
    """The stream ended inside a value."""


class Bad(Exception):
    """A value that a decoder does not accept."""


@dataclass
class Emit:
    value: object


def raw(n: int) -> Decoder:
    """n bytes as they are."""

    def run():
        return (yield n)

    return run


def mapped(of: Decoder, f: Callable) -> Decoder:
    """of, with f applied to what it gives; what f raises as ValueError is a bad value."""

    def run():
        value = yield from of()
        try:
            return f(value)
        except ValueError as e:
            raise Bad(str(e)) from e

    return run


def uint(n: int, order: str = "big") -> Decoder:
    return mapped(raw(n), lambda b: int.from_bytes(b, order))


def sint(n: int, order: str = "big") -> Decoder:
    return mapped(raw(n), lambda b: int.from_bytes(b, order, signed=True))


def utf8(n: int) -> Decoder:
    return mapped(raw(n), lambda b: b.decode("utf-8"))


def kept(of: Decoder, p: Callable, message: str = "a value is not accepted") -> Decoder:
    """of, where a value that p doesn't hold for is bad."""

    def check(v):
        if not p(v):
            raise ValueError(message)
        return v

    return mapped(of, check)


def then(of: Decoder, f: Callable[[object], Decoder]) -> Decoder:
    """A decoder that depends on the value before: f of it."""

    def run():
        value = yield from of()
        return (yield from f(value)())

    return run


def record(**fields: Decoder | Callable[[dict], Decoder]) -> Decoder:
    """A dictionary of fields in order. A field made by after() depends on those before it."""

    def run():
        out: dict = {}
        for name, of in fields.items():
            out[name] = yield from (of.choose(out) if isinstance(of, after) else of)()
        return out

    return run


@dataclass
class after:  # noqa: N801
    """A field whose decoder is chosen by the fields before it."""

    choose: Callable[[dict], Decoder]


def choice(name: str, by: dict[object, Decoder]) -> after:
    """A field that is decoded as the field `name` says; no choice for it is a bad value."""

    def choose(out: dict) -> Decoder:
        if out[name] not in by:
            raise Bad(f"no choice for {out[name]!r}")
        return by[out[name]]

    return after(choose)


def repeat(n: int, of: Decoder) -> Decoder:
    def run():
        out = []
        for _ in range(n):
            out.append((yield from of()))
        return out

    return run


# Stream decoders: they yield Emit(value) and return nothing.


def once(of: Decoder, quiet: bool = False) -> Decoder:
    """One value; quietly none where the stream ends or a value is bad."""

    def run():
        try:
            value = yield from of()
        except (Incomplete, Bad):
            if quiet:
                return
            raise
        yield Emit(value)

    return run


def many(of: Decoder, quiet: bool = False) -> Decoder:
    """Values up to the end of the stream. A bad value, or an end inside one, is an error or, quietly, the end."""

    def run():
        while not (yield AT_END):
            try:
                value = yield from of()
            except (Incomplete, Bad):
                if quiet:
                    return
                raise
            yield Emit(value)

    return run


def emits(values: Iterable) -> Decoder:
    """Values of its own; nothing is read."""

    def run():
        for v in values:
            yield Emit(v)

    return run


def append(*streams: Decoder) -> Decoder:
    """One after another."""

    def run():
        for s in streams:
            yield from s()

    return run


def emitted(stream: Decoder, f: Callable[[object], Decoder]) -> Decoder:
    """For each value of a stream decoder, the stream decoder that f makes of it, read right after it; emits([...]) makes other values of it, or none."""

    def run():
        g = stream()
        step = functools.partial(g.send, None)
        while True:
            try:
                said = step()
            except StopIteration:
                return
            if isinstance(said, Emit):
                yield from f(said.value)()
                step = functools.partial(g.send, None)
                continue
            try:
                step = functools.partial(g.send, (yield said))
            except Incomplete as e:
                step = functools.partial(g.throw, e)

    return run


def ignore(n: int) -> Decoder:
    def run():
        yield n

    return run


def fail(message: str) -> Decoder:
    def run():
        raise Bad(message)
        yield

    return run


def isolate(n: int, stream: Decoder) -> Decoder:
    """A stream decoder over the next n bytes alone: they are its whole stream, and what it leaves of them is passed over."""

    def run():
        held = yield n
        yield from (Emit(v) for v in Feed(stream).all(held))

    return run


class Feed:
    """Gives bytes to a decoder as they come."""

    def __init__(self, stream: Decoder):
        self.decoder, self.held, self.at, self.done = stream(), b"", 0, False
        self.asked = None
        self.begun = False

    def _next(self, send) -> None:
        try:
            self.asked = self.decoder.send(send)
        except StopIteration:
            self.done = True

    def push(self, data: bytes, last: bool = False) -> Iterable:
        """What comes out by these bytes; last: none follow."""
        self.held, self.at = self.held[self.at :] + data, 0
        if not self.begun:
            self.begun = True
            self._next(None)
        while not self.done:
            left = len(self.held) - self.at
            if isinstance(self.asked, Emit):
                yield self.asked.value
                self._next(None)
            elif self.asked == AT_END:
                if not left and not last:
                    return
                self._next(not left)
            elif self.asked <= left:
                piece = self.held[self.at : self.at + self.asked]
                self.at += self.asked
                self._next(piece)
            elif last:
                try:
                    self.asked = self.decoder.throw(Incomplete(f"{self.asked - left} bytes are missing"))
                except StopIteration:
                    self.done = True
            else:
                return

    def all(self, data: bytes) -> list:
        return list(self.push(data, True))

    @property
    def rest(self) -> int:
        """Bytes that were given and not read."""
        return len(self.held) - self.at


def decode_pieces(pieces: DataFrame, stream: Decoder, schema: str, data: str = "data", order: str = "off", key: str = "path", strict: bool = False) -> DataFrame:
    """(key, n, fields): the records of each key's bytes, numbered from 0. schema: the fields, as records (dictionaries) have them. strict: bytes that the decoder leaves are an error at run time."""
    key_type = dict(pieces.dtypes)[key]
    out = _parse_datatype_string(f"`{key}` {key_type}, n long, {schema}")
    assert isinstance(out, StructType)
    arrow, fields = to_arrow_schema(out), [f.name for f in out.fields][2:]
    rows = pieces.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.col(data).cast("binary").alias("__data"))

    def run(batches):
        feed, now, n, made = None, None, 0, []

        def taken(values):
            nonlocal n
            for v in values:
                made.append([now, n, *[v.get(f) for f in fields]])
                n += 1

        def ended():
            taken(feed.push(b"", True))
            if strict and feed.rest:
                raise Bad(f"{feed.rest} bytes are left")

        def sent():
            columns = zip(*made, strict=True) if made else [[]] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
            made.clear()
            return batch

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if feed is None or k != now:
                    if feed is not None:
                        ended()
                    feed, now, n = Feed(stream), k, 0
                taken(feed.push(x or b""))
                if len(made) >= TOGETHER:
                    yield sent()
        if feed is not None:
            ended()
        yield sent()

    return rows.repartition("__key").sortWithinPartitions("__key", "__order").select("__key", "__data").mapInArrow(run, out)
