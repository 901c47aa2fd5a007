"""Several calls of a function in flight at once, for functions that wait (for a service, a disk): per task a window of at most so many calls, over an Arrow iterator.

Tasks already run side by side; a window lets one core wait for many calls. Rows are read only as the window has room, so what is held is the window and one batch. The first failure cancels the calls that have not begun, and is the task's failure. A plain function runs in threads, a coroutine function in an event loop of the task's own.
"""

from __future__ import annotations

import asyncio
import inspect
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

#: Results that are sent on together.
TOGETHER = 1000


def in_order(values: Iterator, f: Callable, most: int) -> Iterator[tuple]:
    """(place, f(value)) in the order of the values, at most `most` calls begun and not yet given out."""
    with ThreadPoolExecutor(most) as pool:
        held: deque = deque()
        try:
            for k, v in enumerate(values):
                held.append((k, pool.submit(f, v)))
                if len(held) >= most:
                    at, call = held.popleft()
                    yield at, call.result()
            while held:
                at, call = held.popleft()
                yield at, call.result()
        finally:
            for _, call in held:
                call.cancel()


def as_done(values: Iterator, f: Callable, most: int) -> Iterator[tuple]:
    """(place, f(value)) as calls end, at most `most` of them in flight."""
    with ThreadPoolExecutor(most) as pool:
        held: dict = {}
        source, left = enumerate(values), True
        try:
            while True:
                while left and len(held) < most:
                    item = next(source, None)
                    if item is None:
                        left = False
                        break
                    held[pool.submit(f, item[1])] = item[0]
                if not held:
                    return
                for call in wait(held, return_when=FIRST_COMPLETED).done:
                    at = held.pop(call)
                    yield at, call.result()
        finally:
            for call in held:
                call.cancel()


def awaited(values: Iterator, f: Callable, most: int, ordered: bool) -> Iterator[tuple]:
    """The same for a coroutine function."""
    loop = asyncio.new_event_loop()
    held: deque = deque()  # (task, place), in the order of the values
    source, left = enumerate(values), True
    try:
        while True:
            while left and len(held) < most:
                item = next(source, None)
                if item is None:
                    left = False
                    break
                held.append((loop.create_task(f(item[1])), item[0]))
            if not held:
                return
            if ordered:
                done = {held[0][0]}
                loop.run_until_complete(asyncio.wait(done))
            else:
                done, _ = loop.run_until_complete(asyncio.wait([t for t, _ in held], return_when=asyncio.FIRST_COMPLETED))
            for task, at in [x for x in held if x[0] in done]:
                held.remove((task, at))
                yield at, task.result()
    finally:
        for task, _ in held:
            task.cancel()
        if held:
            loop.run_until_complete(asyncio.wait([t for t, _ in held]))
        loop.close()


def window(values: Iterator, f: Callable, most: int, ordered: bool = True) -> Iterator[tuple]:
    """(place, f(value)) with at most `most` calls in flight."""
    if most < 1:
        raise ValueError("one call at least")
    if inspect.iscoroutinefunction(f):
        return awaited(values, f, most, ordered)
    return (in_order if ordered else as_done)(values, f, most)


def par_eval_map(df: DataFrame, column: str, f: Callable, type_: str, name: str, most: int, ordered: bool = True) -> DataFrame:
    """Adds f of each value of a column, at most `most` calls of a task in flight. Unordered, a task's rows come as their calls end, so that a slow one holds up none; a row keeps its own columns either way. A task that is tried again calls again."""
    kind = _parse_datatype_string(type_)
    schema = StructType([*df.schema.fields, *StructType().add(name, kind).fields])
    at, arrow = df.columns.index(column), to_arrow_type(kind)

    def run(batches):
        rows: dict = {}

        def values():
            k = 0
            for batch in batches:
                for i, v in enumerate(batch.column(at).to_pylist()):
                    rows[k] = batch.slice(i, 1)
                    k += 1
                    yield v

        def sent(parts, results):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(results, arrow)], [*whole.schema.names, name])

        parts, results = [], []
        for place, result in window(values(), f, most, ordered):
            parts.append(rows.pop(place))
            results.append(result)
            if len(parts) == TOGETHER:
                yield sent(parts, results)
                parts, results = [], []
        if parts:
            yield sent(parts, results)

    return df.mapInArrow(run, schema)
