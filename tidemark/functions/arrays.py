"""Chunk operations on array columns, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, max(n, 0))


def drop(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def take_right(a: Column, n: int) -> Column:
    return F.reverse(take(F.reverse(a), n))


def drop_right(a: Column, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def zip_with(a: Column, b: Column, f) -> Column:
    """As far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f)


def scan_left(a: Column, zero: Column, f) -> Column:
    """The states after none, one, two ... elements."""
    return F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))


def zip_with_index(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(x.alias("value"), i.alias("index")))


def index_where(a: Column, p) -> Column:
    """Place of the first element that p holds for, null if there is none."""
    hits = F.filter(F.transform(a, lambda x, i: F.when(p(x), i)), lambda i: i.isNotNull())
    return F.get(hits, 0)


def take_while(a: Column, p) -> Column:
    return F.slice(a, 1, F.coalesce(index_where(a, lambda x: ~p(x)), F.size(a)))


def split_at(a: Column, n: int) -> tuple[Column, Column]:
    return take(a, n), drop(a, n)


def starts_with(a: Column, prefix: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(prefix)) == prefix


def map_filter(a: Column, f) -> Column:
    """f of each element, where it is defined."""
    return F.filter(F.transform(a, f), lambda x: x.isNotNull())


def map_accumulate(a: Column, zero: Column, f) -> Column:
    """The state after each element, without the first one."""
    return drop(scan_left(a, zero, f), 1)


def scan_left_carry(a: Column, zero: Column, f) -> Column:
    """struct(states, carry): the states before each element, and the last state, which the next array goes on with."""
    states = scan_left(a, zero, f)
    return F.struct(drop_right(states, 1).alias("states"), F.element_at(states, -1).alias("carry"))


def contains(a: Column, value: Column) -> Column:
    return F.array_contains(a, value)


def fold_left(a: Column, zero: Column, f) -> Column:
    return F.aggregate(a, zero, f)


def flat_map(a: Column, f) -> Column:
    """f of each element is an array; all in a row."""
    return F.flatten(F.transform(a, f))


def last(a: Column) -> Column:
    """Null if there is none."""
    return F.get(a, F.size(a) - 1)


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def count(a: Column, p) -> Column:
    return F.size(F.filter(a, p))


def compact_nulls(a: Column) -> Column:
    return F.array_compact(a)


def singleton(x: Column) -> Column:
    return F.array(x)


def constant(x: Column, n: int) -> Column:
    return F.array_repeat(x, max(n, 0))


def from_option(x: Column) -> Column:
    """One element, or none for null."""
    return F.array_compact(F.array(x))


def first_of_queue(parts: Column, n: int) -> tuple[Column, Column]:
    """The first n elements of an array of arrays, as one array, and the rest."""
    return split_at(F.flatten(parts), n)


def take_exactly(a: Column, n: int) -> Column:
    """The first n elements, null where there are fewer."""
    return F.when(F.size(a) >= n, take(a, n))


def collect_while(a: Column, f) -> Column:
    """f of each element up to the first one for which it is null."""
    return take_while(F.transform(a, f), lambda x: x.isNotNull())


def traverse(a: Column, f) -> Column:
    """f of each element, or null if f is null for any."""
    return F.when(F.forall(F.transform(a, f), lambda x: x.isNotNull()), F.transform(a, f))


def traverse_filter(a: Column, f, keep) -> Column:
    """f of the elements that keep(f) lets through, or null if f is null for any."""
    return F.filter(traverse(a, f), keep)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def zip_pairs(a: Column, b: Column) -> Column:
    """Structs of (left, right), as far as the shorter goes."""
    return zip_with(a, b, lambda x, y: F.struct(x.alias("left"), y.alias("right")))
