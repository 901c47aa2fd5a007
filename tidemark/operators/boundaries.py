"""Groups whose ends depend on where the group before ended: debounce, size-or-time groups and least chunks, without walking a sequence in one task.

If a group begins at row i, the next one begins at row next(i), whatever came before; the groups' first rows are what is reached from the sequence's first row by following next. So all rows find their next() at once, by a sorted search: rows and sought values are sorted together, and the number of rows before a sought value is the row where it is found. Then each block of BLOCK neighbouring rows finds for each of its rows where a walk from it leaves the block. A walk enters a block once at most, and only where one can leave another block; those entries are few, and pointer doubling (a join of the entries with themselves, as often as the number of blocks has binary digits) tells which of them the walk from the first row meets. Last, each block is walked from its own entry.

With keys, each key's rows are a sequence: its first row always begins a group. Keys only take part in the sort, so a key of any size is split over blocks like any other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running, with_index
from tidemark.operators.storage import pinned

#: Neighbouring rows that are walked together.
BLOCK = 1 << 16


def searched(rows: DataFrame, value: Column, sought: Column, keys: list[str]) -> DataFrame:
    """__i and __found of every row: the position of the first row of its key whose value is at least `sought`, or else of the row after its key. rows have positions __i in the order of the keys and values."""
    asked = rows.select(*keys, sought.alias("__x"), F.lit(0).alias("__there"), "__i")
    there = rows.select(*keys, value.alias("__x"), F.lit(1).alias("__there"), "__i")
    # A sought value stands before equal values, so that those before it are the smaller ones.
    both = running(asked.unionByName(there).withColumnRenamed("__i", "__row"), F.col("__there"), "__found", "sum", [*keys, "__x", "__there"])
    return both.filter("__there = 0").select(F.col("__row").alias("__i"), F.col("__found").cast("long").alias("__found"))


def _leaving(part: pd.DataFrame) -> pd.DataFrame:
    """For each row of a block, where a walk from it leaves the block."""
    part = part.sort_values("__i", kind="stable")
    lo, goes = int(part["__i"].iloc[0]), part["__next"].to_numpy(np.int64).copy()
    hi = lo + len(goes)
    while (inside := goes < hi).any():
        goes[inside] = goes[goes[inside] - lo]
    return pd.DataFrame({"__i": part["__i"].to_numpy(np.int64), "__leaves": goes})


def _walked(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that a walk from its entry meets."""
    part = part.sort_values("__i", kind="stable")
    if part.empty or entry.empty:
        return pd.DataFrame({"__i": np.zeros(0, np.int64)})
    lo, goes, at, met = int(part["__i"].iloc[0]), part["__next"].to_numpy(np.int64), int(entry["__entry"].iloc[0]), []
    while at < lo + len(goes):
        met.append(at)
        at = int(goes[at - lo])
    return pd.DataFrame({"__i": np.array(met, np.int64)})


def reached(nexts: DataFrame, block: int = 0) -> DataFrame:
    """__i of the rows that a walk from row 0 meets. nexts: __i from 0 without gaps, and __next, which is larger."""
    size = block or BLOCK
    of_block = F.floor(F.col("__i") / size)
    nexts = pinned(nexts.select("__i", "__next", of_block.alias("__block")))
    leaves = pinned(nexts.groupBy("__block").applyInPandas(_leaving, "__i long, __leaves long"))
    entries = leaves.select(F.col("__leaves").alias("__i")).distinct().unionByName(leaves.filter("__i = 0").select("__i")).distinct()
    jumps = leaves.join(entries, "__i").select("__i", F.col("__leaves").alias("__to"))
    last = F.broadcast(nexts.agg(F.max("__i").alias("__last")))
    jumps = pinned(jumps.crossJoin(last).filter("__to <= __last").drop("__last"))
    met = nexts.filter("__i = 0").select("__i")
    while not jumps.isEmpty():
        met = pinned(met.unionByName(met.join(jumps, "__i").select(F.col("__to").alias("__i"))))
        jumps = pinned(jumps.join(jumps.select(F.col("__i").alias("__to"), F.col("__to").alias("__further")), "__to").select("__i", F.col("__further").alias("__to")))
    return nexts.groupBy("__block").cogroup(met.select(F.col("__i").alias("__entry"), of_block.alias("__of")).groupBy("__of")).applyInPandas(_walked, "__i long")


def _grouped(rows: DataFrame, nexts: DataFrame) -> DataFrame:
    """rows with __group, the number of their group from 0 in the whole order, and __begins."""
    begins = reached(nexts).withColumn("__begins", F.lit(True))
    marked = rows.join(begins, "__i", "left").withColumn("__begins", F.coalesce("__begins", F.lit(False)))
    return running(marked.withColumnRenamed("__i", "__pos"), F.col("__begins").cast("long"), "__group", "sum", "__pos").withColumn("__group", F.col("__group") - 1)


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    return pinned(with_index(df, order, name="__i"))


def group_within(df: DataFrame, size: int, wait: int, time: str = "us", order: str = "seq", key: str | list[str] | None = None) -> DataFrame:
    """df with group: numbers, from 0 for each key, of groups that close after `size` rows or as soon as a row comes `wait` or more after their first. Rows are in the order of time, then of `order`."""
    if size < 1 or wait <= 0:
        raise ValueError("size and wait must be positive")
    keys = [key] if isinstance(key, str) else list(key or [])
    rows = _placed(df, [*keys, time, order])
    found = searched(rows, F.col(time), F.col(time) + wait, keys)
    nexts = found.select("__i", F.least(F.col("__found"), F.col("__i") + size).alias("__next"))
    if keys:  # no group goes on in the next key
        firsts = searched(rows, F.lit(0), F.lit(1), keys).withColumnRenamed("__found", "__end")
        nexts = nexts.join(firsts, "__i").select("__i", F.least("__next", "__end").alias("__next"))
    out = _grouped(rows, nexts)
    if not keys:
        return out.withColumnRenamed("__group", "group").drop("__pos", "__begins")
    same = [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)]
    first = out.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]).agg(F.min("__group").alias("__first"))
    joined = out.join(first, same)
    return joined.withColumn("group", F.col("__group") - F.col("__first")).select(*df.columns, "group")


def debounce(df: DataFrame, wait: int, time: str = "us", order: str = "seq", key: str | list[str] | None = None) -> DataFrame:
    """The last row of each span: a span opens with a row and takes in what comes before its time plus `wait`. Rows are in the order of time, then of `order`."""
    if wait <= 0:
        raise ValueError("wait must be positive")
    keys = [key] if isinstance(key, str) else list(key or [])
    rows = _placed(df, [*keys, time, order])
    nexts = pinned(searched(rows, F.col(time), F.col(time) + wait, keys).select("__i", F.col("__found").alias("__next")))
    last = rows.agg(F.max("__i").alias("__i")).filter("__i IS NOT NULL")
    ends = reached(nexts).filter("__i > 0").select((F.col("__i") - 1).alias("__i")).unionByName(last)
    return rows.join(ends, "__i", "left_semi").select(*df.columns)


def chunk_min(chunks: DataFrame, least: int, partial: bool = True, n: str = "n", order: str = "chunk") -> DataFrame:
    """chunks, rows of (order, n), with group: numbers from 0 of groups of whole neighbouring chunks, each closed as soon as it has `least` rows. A last group that never gets so many stays only if partial."""
    if least < 1:
        raise ValueError("least must be positive")
    rows = pinned(running(_placed(chunks, [order]).withColumnRenamed("__i", "__pos"), F.col(n).cast("long"), "__sum", "sum", "__pos").withColumnRenamed("__pos", "__i"))
    closes = searched(rows, F.col("__sum"), F.col("__sum") - F.col(n) + least, [])
    out = _grouped(rows, closes.select("__i", (F.col("__found") + 1).alias("__next")))
    if not partial:
        whole = out.groupBy("__group").agg(F.sum(n).alias("__n")).filter(F.col("__n") >= least).select("__group")
        out = out.join(whole, "__group", "left_semi")
    return out.select(*chunks.columns, F.col("__group").alias("group"))
