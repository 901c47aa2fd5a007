"""Folds (one row always), reductions (no row for an empty sequence) and running scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import before, running, upto, with_index

#: Monoids: how a column folds, and its value for no rows.
MONOIDS = {"sum": (F.sum, 0), "min": (F.min, None), "max": (F.max, None), "all": (F.bool_and, True), "any": (F.bool_or, False), "count": (F.count, 0)}


def fold(df: DataFrame, value: Column, how: str = "sum", name: str = "result", seed=None) -> DataFrame:
    f, zero = MONOIDS[how]
    out = F.coalesce(f(value), F.lit(zero))
    if seed is not None:
        out = {"sum": lambda: out + F.lit(seed), "min": lambda: F.least(out, F.lit(seed)), "max": lambda: F.greatest(out, F.lit(seed))}[how]()
    return df.agg(out.alias(name))


def fold1(df: DataFrame, value: Column, how: str = "max", name: str = "result") -> DataFrame:
    return df.agg(MONOIDS[how][0](value).alias(name), F.count("*").alias("__n")).filter("__n > 0").drop("__n")


def scan(df: DataFrame, value: Column, how: str = "sum", seed=0, name: str = "state", order="seq") -> DataFrame:
    """The seed, then the state after each row: (pos, state)."""
    rows = with_index(running(df, value, "__s", how, order), order, name="pos").select((F.col("pos") + 1).alias("pos"), "__s")
    state = {"sum": lambda: F.col("__s") + F.lit(seed), "min": lambda: F.least("__s", F.lit(seed)), "max": lambda: F.greatest("__s", F.lit(seed))}[how]()
    first = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit(seed).alias(name))
    return rows.select("pos", state.alias(name)).unionByName(first)


def scan1(df: DataFrame, value: Column, how: str = "max", name: str = "state", order="seq", key=None) -> DataFrame:
    return running(df, value, name, how, order, key)


def zip_with_scan(df: DataFrame, value: Column, seed=0, name: str = "state", order="seq", key=None, after: bool = False) -> DataFrame:
    """Each row with the running sum before it, or after it."""
    if key:
        return df.withColumn(name, F.coalesce(F.sum(value).over(upto(order, key) if after else before(order, key)), F.lit(0)) + F.lit(seed))
    out = running(df, value, name, "sum", order)
    return out.withColumn(name, F.col(name) + F.lit(seed) if after else F.col(name) - F.coalesce(value, F.lit(0)) + F.lit(seed))


def compiled_list(df: DataFrame, value: Column, key: str, order="seq", name: str = "values") -> DataFrame:
    """(key, values): each key's values in order. A key's list is one value, so keys must be as small as a row may be."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def compiled_string(df: DataFrame, value: Column, key: str, order="seq", name: str = "text") -> DataFrame:
    """(key, text): each key's strings in order, joined; nulls are left out."""
    return compiled_list(df, value, key, order, name).withColumn(name, F.array_join(name, ""))
