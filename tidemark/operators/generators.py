"""Sequences from nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def range_(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """A step of 0 gives an empty sequence."""
    return spark.range(0) if step == 0 else spark.range(start, stop, step)


def ranges(spark: SparkSession, start: int, stop: int, size: int) -> DataFrame:
    """(lo, hi) pieces that cover start to stop."""
    if size <= 0:
        raise ValueError("size is positive")
    return spark.range(start, stop, size).select(F.col("id").alias("lo"), F.least(F.col("id") + size, F.lit(stop)).alias("hi"))


def constant(spark: SparkSession, value, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), F.lit(value).alias("value"))


def emits(spark: SparkSession, values: list, kind: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")).alias("seq", "value")).withColumn("seq", F.col("seq").cast("long"))


def iterate(spark: SparkSession, start: str, following: str, until: str) -> DataFrame:
    """SQL expressions over v: v = start, then following, while until holds: (seq, v)."""
    return spark.sql(f"WITH RECURSIVE r(seq, v) AS (SELECT 0L, {start} UNION ALL SELECT seq + 1, {following} FROM r WHERE {until}) SELECT seq, v FROM r")


def unfold(spark: SparkSession, state, step: Callable, kind: str, batch: int = 10_000) -> DataFrame:
    """step(state) gives (value, state) or None; runs in one generator task, which holds `batch` values at a time. A step that never ends makes rows as long as they are asked for."""

    def run(batches):
        import pandas as pd

        for _ in batches:
            s, n, out = state, 0, []
            while (got := step(s)) is not None:
                v, s = got
                out.append(v)
                if len(out) == batch:
                    yield pd.DataFrame({"seq": range(n, n + batch), "value": out})
                    n, out = n + batch, []
            yield pd.DataFrame({"seq": range(n, n + len(out)), "value": out})

    return spark.range(1).mapInPandas(run, f"seq long, value {kind}")


def fixed_rate(spark: SparkSession, start_us: int, period: int, n: int, immediately: bool = False) -> DataFrame:
    """(seq, us): n ticks, one a period after start_us, the first at once or after a period."""
    return spark.range(n).select(F.col("id").alias("seq"), (F.lit(start_us) + (F.col("id") + (0 if immediately else 1)) * F.lit(period).cast("long")).alias("us"))


def unfold_chunk(spark: SparkSession, state, step: Callable, kind: str) -> DataFrame:
    """step(state) gives (values, state) or None; the values of all steps in a row."""

    def one(held):
        s, rest, at = held
        while at == len(rest):
            if (got := step(s)) is None:
                return None
            rest, s, at = list(got[0]), got[1], 0
        return rest[at], (s, rest, at + 1)

    return unfold(spark, (state, [], 0), one, kind)


def unfold_chunk_loop(spark: SparkSession, state, step: Callable, kind: str) -> DataFrame:
    """step(state) gives (values, state or None); the values of all steps in a row, of one step at least."""

    def chunk(held):
        if held is None:
            return None
        values, s = step(held[0])
        return values, None if s is None else (s,)

    return unfold_chunk(spark, (state,), chunk, kind)


def iterate_eval(spark: SparkSession, start, following: Callable, kind: str) -> DataFrame:
    """start, following(start) and so on without end; take what is needed with limit."""
    return unfold(spark, start, lambda v: (v, following(v)), kind)


def repeat_eval(spark: SparkSession, effect: Callable, n: int, kind: str) -> DataFrame:
    """The values of n runs of effect, on as many tasks as there are partitions."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"seq": batch["id"], "value": [effect() for _ in range(len(batch))]})

    return spark.range(n).mapInPandas(run, f"seq long, value {kind}")


def evals(spark: SparkSession, effect: Callable, kind: str) -> DataFrame:
    """The values that one run of effect, in a task, gives."""
    return unfold_chunk(spark, True, lambda first: (effect(), False) if first else None, kind)


def from_option(spark: SparkSession, value, kind: str) -> DataFrame:
    """One row, or none for None."""
    return emits(spark, [] if value is None else [value], kind)


def unfold_loop(spark: SparkSession, state, step: Callable, kind: str) -> DataFrame:
    """step(state) gives (value, state or None); there is one value at least."""

    def one(held):
        if held is None:
            return None
        v, s = step(held[0])
        return v, None if s is None else (s,)

    return unfold(spark, (state,), one, kind)
