"""Ordered rows with short values, packed into runs: neighbours that follow one another in the input become one row.

A run is rows of one key, in ascending order, no other row of the key between them. What sorts, joins or exchanges rims then moves a row for each run instead of one for each piece, and a run's bytes lie one after another as they did in the pieces. Rows are packed where they are read, without a shuffle; whether runs interleave is seen from their first and last orders, and if so the rows are sorted and packed again. So the layout of the input decides about cost only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import near
from tidemark.operators.storage import pinned, stored

#: Bytes of a run (about), and rows that one batch of unpacked runs has (about).
BYTES, ROWS = 1 << 18, 1 << 16


def offsets(a: pa.Array) -> np.ndarray:
    """Where the values of an array of bytes, texts or lists begin in its buffer, and where the last one ends."""
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)


def _leaves(a: pa.Array) -> list[pa.Array]:
    return [x for f in a.flatten() for x in _leaves(f)] if pa.types.is_struct(a.type) else [a]


def _compared(a: pa.Array, f) -> np.ndarray:
    """f of each row and the next one; false where either is null."""
    return np.asarray(pc.fill_null(f(a[:-1], a[1:]), False))


def _same(a: pa.Array) -> np.ndarray:
    null = np.asarray(a.is_null())
    return _compared(a, pc.equal) | (null[:-1] & null[1:])


def _ascends(a: pa.Array) -> np.ndarray:
    """Whether a row's successor comes after it; false if in doubt."""
    less, tie = False, True
    for x in _leaves(a):
        less = less | (tie & _compared(x, pc.less))
        tie = tie & _compared(x, pc.equal)
    return less


def _packer(n_keys: int, whole: bool, limit: int) -> Callable:
    """Batches of the keys, the order, the value and other columns -> batches of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, order, value, others = batch.columns[:n_keys], batch.column(n_keys), batch.column(n_keys + 1), batch.columns[n_keys + 2 :]
            at = offsets(value)
            begins = np.ones(n, bool)
            try:
                follows = _ascends(order) & (at[1:-1] // limit == at[:-2] // limit)
                for x in [x for k in keys for x in _leaves(k)]:
                    follows = follows & _same(x)
                begins[1:] = ~follows
            except pa.ArrowNotImplementedError:  # a type that Arrow doesn't compare: each row is a run
                pass
            starts = np.flatnonzero(begins)
            bounds = np.append(starts, n).astype(np.int32)
            listed = lambda a, bounds=bounds: pa.ListArray.from_arrays(pa.array(bounds), a)
            steps = order
            if whole:
                number = order.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                steps = np.diff(number, prepend=number[:1])
                steps[starts] = 0
                steps = pa.array(steps)
            held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(at[bounds])), value.buffers()[2]])
            columns = [*[k.take(pa.array(starts)) for k in keys], order.take(pa.array(starts)), order.take(pa.array(bounds[1:] - 1)), listed(steps), listed(pa.array(np.diff(at))), held, *map(listed, others)]
            names = [*batch.schema.names[:n_keys], "__lo", "__hi", "__steps", "__sizes", "__value", *batch.schema.names[n_keys + 2 :]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def by_steps(kind: T.DataType) -> bool:
    """Whether orders of a type are kept as differences."""
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def packed(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of df: the keys; __lo and __hi, the first and the last order; __steps, the orders (of whole numbers, the differences from the row before); __sizes, the bytes of each value; __value, all values' bytes; and an array for every other column. Rows without a value are left out. Runs are stored, and don't interleave."""
    others = [c for c in df.columns if c not in (*keys, order, value)]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("binary").alias(value), *others)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    whole = by_steps(kind[order])
    columns = [*[(k, kind[k]) for k in keys], ("__lo", kind[order]), ("__hi", kind[order]), ("__steps", T.ArrayType(T.LongType() if whole else kind[order])), ("__sizes", T.ArrayType(T.IntegerType())), ("__value", T.BinaryType()), *[(c, T.ArrayType(kind[c])) for c in others]]
    schema = T.StructType([T.StructField(*c) for c in columns])
    made = lambda x: stored(x.mapInArrow(_packer(len(keys), whole, BYTES), schema), "runs")
    runs = made(rows)
    return made(rows.sort(*keys, order)) if _interleaved(runs, keys) else runs


def _interleaved(runs: DataFrame, keys: list[str]) -> bool:
    ends = runs.select(*keys, "__lo", "__hi")

    def columns(w) -> dict[str, Column]:
        last = F.lag(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "__hi")).over(w)
        same = last.isNotNull()
        for i, k in enumerate(keys):
            same = same & last[f"k{i}"].eqNullSafe(F.col(k))
        return {"__meets": same & F.coalesce(last["__hi"] >= F.col("__lo"), F.lit(True))}

    return not near(ends, columns, 1, 0, [*keys, "__lo"]).filter("__meets").isEmpty()


#: Rows that are sent to every task.
FEW = 1 << 17


def with_few(runs: DataFrame, some: DataFrame, on: Column) -> DataFrame:
    """runs left-joined with narrow rows that most runs have none of: while there are few of them, runs don't move."""
    some = pinned(some)
    return runs.join(F.broadcast(some) if some.limit(FEW + 1).count() <= FEW else some, on, "left")


def unpacked(runs: DataFrame, columns: list[tuple[str, T.DataType]], f: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Rows of runs by f, which makes arrays for the columns from a batch of whole runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(np.diff(offsets(batch.column("__sizes"))), dtype=np.int64)
            size = np.cumsum(np.diff(offsets(batch.column("__value"))), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // ROWS + size // (ROWS << 6))) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield pa.RecordBatch.from_arrays(f(batch.slice(a, b - a)), [c for c, _ in columns])

    return runs.mapInArrow(run, T.StructType([T.StructField(*c) for c in columns]))


def orders(batch: pa.RecordBatch, whole: bool) -> pa.Array:
    """The orders of all rows of a batch of runs."""
    steps = batch.column("__steps").flatten()
    if not whole:
        return steps
    lo, bounds = batch.column("__lo"), offsets(batch.column("__steps"))
    bounds = bounds - bounds[0]
    number = np.cumsum(steps.to_numpy(zero_copy_only=False))
    first = lo.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) - number[bounds[:-1]]
    n = np.diff(bounds)
    null = np.repeat(np.asarray(lo.is_null()), n)
    return pa.array(number + np.repeat(first, n), mask=null).cast(lo.type)
