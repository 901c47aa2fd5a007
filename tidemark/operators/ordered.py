"""Positions, neighbours and running values over a totally ordered frame, without a single-task window.

Order is a column (seq by default), never partition layout. A key makes one sequence per key, served by ordinary windows. Without a key a frame is range-sorted once and written to the shared folder; positions come from per-partition counts, neighbours from blocks of rows with a copied rim, running values from block totals. Only counts and block totals are brought together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.storage import pinned

#: Rows of a block in unkeyed windows.
BLOCK = 1 << 16


def window(order: str = "seq", key: str | list[str] | None = None):
    keys = [key] if isinstance(key, str) else list(key or [])
    return Window.partitionBy(*keys).orderBy(order)


def upto(order: str = "seq", key=None):
    return window(order, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(order: str = "seq", key=None):
    return window(order, key).rowsBetween(Window.unboundedPreceding, -1)


def with_index(df: DataFrame, order: str = "seq", key: str | None = None, name: str = "idx") -> DataFrame:
    """Adds the 0-based position in order (of each key).

    Without a key the sorted rows are pinned: a second evaluation of the sort could draw other range bounds, or be coalesced otherwise, and partition numbers would not fit their counts.
    """
    if key:
        return df.withColumn(name, F.row_number().over(window(order, key)).cast("long") - 1)
    placed = pinned(df.sort(order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").count()
    starts = counts.withColumn("__start", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__start", F.lit(0)).alias("__start"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, local + F.col("__start")).drop("__at", "__part", "__start")


def near(df: DataFrame, columns: Callable, back: int = 1, ahead: int = 1, order: str = "seq", key: str | None = None) -> DataFrame:
    """df with the columns that `columns(window)` makes from at most `back` earlier and `ahead` later rows."""
    if key:
        return df.withColumns(columns(window(order, key)))
    rows = with_index(df, order, name="__i")
    reach = max(back, ahead, 1)
    size = max(BLOCK, 2 * reach)
    block, at = F.floor(F.col("__i") / size), F.col("__i") % size
    copies = F.array_compact(F.array(block, F.when(at < ahead, block - 1), F.when(at >= size - back, block + 1)))
    spread = rows.withColumn("__own", block).withColumn("__block", F.explode(copies)).filter("__block >= 0")
    return spread.withColumns(columns(Window.partitionBy("__block").orderBy("__i"))).filter("__block = __own").drop("__i", "__own", "__block")


def running(df: DataFrame, value: Column, name: str, how: str = "sum", order: str = "seq", key: str | None = None) -> DataFrame:
    """Adds the running sum, min or max of value up to each row."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    if key:
        return df.withColumn(name, f(value).over(upto(order, key)))
    rows = with_index(df, order, name="__i").withColumn("__v", value).withColumn("__block", F.floor(F.col("__i") / BLOCK))
    totals = rows.groupBy("__block").agg(f("__v").alias("__t")).withColumn("__before", f("__t").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).select("__block", "__before")
    inside = rows.withColumn("__in", f("__v").over(Window.partitionBy("__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)))
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    joined = inside.join(totals, "__block")
    return joined.withColumn(name, F.coalesce(both(F.col("__in"), F.col("__before")), "__in", "__before")).drop("__i", "__v", "__block", "__in", "__before")


def scalar(df: DataFrame, aggregate: Column, name: str) -> DataFrame:
    """A one-row frame to be cross-joined: one number about the whole sequence."""
    return df.agg(aggregate.alias(name))


def with_scalar(df: DataFrame, aggregate: Column, name: str, of: DataFrame | None = None) -> DataFrame:
    """df with one aggregate of the whole frame (or of another one) on every row; the aggregate is one row by construction."""
    return df.crossJoin(F.broadcast(scalar(df if of is None else of, aggregate, name)))


#: Numbers that one row makes at once in spread().
SPREAD = 4096


def spread(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """Rows for every number from low to high, none if low is the larger one. Blocks of numbers are made first, then the numbers of each, so that no row holds a long list of them."""
    rows = df.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).filter("__low <= __high")
    block = lambda c: F.floor(F.col(c) / SPREAD)
    blocks = rows.withColumn("__b", F.explode(F.sequence(block("__low"), block("__high"))))
    first = F.col("__b") * SPREAD
    return blocks.withColumn(name, F.explode(F.sequence(F.greatest("__low", first), F.least(F.col("__high"), first + SPREAD - 1)))).drop("__low", "__high", "__b")
