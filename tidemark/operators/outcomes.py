"""Rows whose processing may fail: failures as data, checks, fallbacks and repeated attempts.

A failure is a column of its own (an error text, null where a row is fine), so that it can be looked at, cut at or raised.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import near, with_scalar
from tidemark.operators.selection import take_through, take_while, true


def attempt(df: DataFrame, value: Column, error: Column, order="seq", key=None) -> DataFrame:
    """Adds result and error, and ends with the first row that fails, which has an error and no result."""
    rows = df.withColumn("error", error.cast("string")).withColumn("result", F.when(F.col("error").isNull(), value))
    return take_through(rows, F.col("error").isNull(), order, key)


def ensure(df: DataFrame, p: Column, message: str) -> DataFrame:
    """df, or an error at run time where a row fails p; a null counts as failing."""
    return df.filter(F.when(true(p), F.lit(True)).otherwise(F.raise_error(F.lit(message))))


def rethrow(df: DataFrame, error: str = "error") -> DataFrame:
    """df without its error column, or that error at run time."""
    return df.filter(F.when(F.col(error).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(error)))).drop(error)


def mask(df: DataFrame, error: Column, order="seq", key=None) -> DataFrame:
    """The rows before the first failure, which itself is forgotten."""
    return take_while(df.withColumn("__e", error), F.col("__e").isNull(), order, key).drop("__e")


def handle_error_with(df: DataFrame, error: Column, other: DataFrame, order="seq") -> DataFrame:
    """The rows before the first failure (part 0), then those of other (part 1) if there was one: (part, order) is the new order."""
    failed = df.agg(F.coalesce(F.bool_or(error.isNotNull()), F.lit(False)).alias("__failed"))
    instead = other.crossJoin(F.broadcast(failed)).filter("__failed").drop("__failed")
    return mask(df, error, order).withColumn("part", F.lit(0)).unionByName(instead.withColumn("part", F.lit(1)))


def retry(action: Callable, attempts: int, delay: float = 0.0, next_delay: Callable[[float], float] = lambda d: d, retriable: Callable[[Exception], bool] = lambda e: True):
    """What action() returns, called up to `attempts` times with growing pauses; the last error is raised. For actions (writes, counts) of a driver; tasks are retried by Spark itself."""
    if attempts < 1:
        raise ValueError("one attempt at least")
    for left in range(attempts - 1, -1, -1):
        try:
            return action()
        except Exception as e:
            if not left or not retriable(e):
                raise
        time.sleep(delay)
        delay = next_delay(delay)


def eval_map(df: DataFrame, column: str, f: Callable, type_: str, name: str) -> DataFrame:
    """Adds f of each value of a column; f is a Python function, sent rows in Arrow batches, many batches at once over the cluster."""
    return df.withColumn(name, F.pandas_udf(lambda s: pd.Series([f(v) for v in s], dtype=object), type_)(F.col(column)))


def eval_filter(df: DataFrame, column: str, p: Callable) -> DataFrame:
    """Rows whose value the Python predicate holds for."""
    return eval_map(df, column, lambda v: bool(p(v)), "boolean", "__p").filter("__p").drop("__p")


def only_or_error(df: DataFrame) -> DataFrame:
    """The single row of df, or an error at run time where it has none or several."""
    several = with_scalar(df.limit(2), F.count("*"), "__n").filter(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True))).drop("__n")
    none = df.limit(1).agg(F.count("*").alias("__n")).filter(F.when(F.col("__n") == 0, F.raise_error(F.lit("no row"))).otherwise(F.lit(False)))
    return several.unionByName(none.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


def eval_map_filter(df: DataFrame, column: str, f: Callable, type_: str, name: str) -> DataFrame:
    """Like eval_map, without the rows for which f gives None."""
    return eval_map(df, column, f, type_, name).filter(F.col(name).isNotNull())


def timeout_on_pull_to(df: DataFrame, duration: int, other: DataFrame, order="seq", ts="ts") -> DataFrame:
    """The rows before the first gap longer than duration (part 0), then, if there is such a gap, those of other (part 1): (part, order) is the new order. other has the columns of df."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = near(df.withColumn("__us", us), lambda w: {"__gap": F.col("__us") - F.lag("__us").over(w)}, 1, 0, order)
    return handle_error_with(gaps.drop("__us"), F.when(F.col("__gap") > duration, "timed out"), other.withColumn("__gap", F.lit(None).cast("long")), order).drop("__gap")


def map_chunks(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each physical batch of rows; what f does must not depend on where batches end."""
    return df.mapInPandas(lambda parts: (f(p) for p in parts), schema)


def eval_tap(df: DataFrame, column: str, effect: Callable) -> DataFrame:
    """df, with effect run on each value of a column; what it returns is forgotten, an error of it fails the query. A task that is tried again runs its effects again."""

    def done(v) -> bool:
        effect(v)
        return True

    return eval_filter(df, column, done)


def eval_filter_not(df: DataFrame, column: str, p: Callable) -> DataFrame:
    """Rows whose value the Python predicate doesn't hold for."""
    return eval_filter(df, column, lambda v: not p(v))


def from_either(df: DataFrame, left: str, right: str) -> DataFrame:
    """The right values, or at run time the error that a left value names."""
    return rethrow(df.filter(F.col(left).isNotNull() | F.col(right).isNotNull()), left)


def on_complete(df: DataFrame, error: Column, other: DataFrame, order="seq") -> DataFrame:
    """The rows before the first failure (part 0), those of other in any case (part 1), and the failure, if there was one, as a last row of its own (part 2, `failed` its text): (part, order) is the new order."""
    first = df.withColumn("__e", error.cast("string")).filter("__e is not null").agg(F.min_by("__e", order).alias("failed"), F.min(order).alias(order)).filter("failed is not null").withColumn("part", F.lit(2))
    rows = mask(df, error, order).withColumn("part", F.lit(0)).unionByName(other.withColumn("part", F.lit(1)))
    return rows.withColumn("failed", F.lit(None).cast("string")).unionByName(first, allowMissingColumns=True)


def observe_either(df: DataFrame, is_left: Column, left: Callable[[DataFrame], DataFrame], right: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows, each handed to an observer of its own; a null test is right."""
    return left(df.filter(true(is_left))), right(df.filter(~true(is_left)))
