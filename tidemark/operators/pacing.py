"""Pacing, pauses and ends, replayed in event time over (seq, ts). Durations are in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import near, running, spread, with_index, with_scalar
from tidemark.operators.pairing import latest
from tidemark.operators.timeseries import micros


def metered(df: DataFrame, period: int, order="seq", immediately: bool = False, name: str = "emit_us") -> DataFrame:
    """Adds the time after the start at which a row is let go: one row a period, the first after a period or at once."""
    return with_index(df, order, name="__i").withColumn(name, (F.col("__i") + (0 if immediately else 1)) * F.lit(period).cast("long")).drop("__i")


def delay_by(df: DataFrame, delay: int, ts="ts") -> DataFrame:
    """All rows later by delay."""
    return df.withColumn(ts, F.timestamp_micros(micros(ts) + delay))


def keep_alive(df: DataFrame, idle: int, order="seq", ts="ts") -> DataFrame:
    """(seq, us, beat): the rows and, in gaps, a heartbeat after every `idle`; its seq is that of the row before the gap. A gap makes its own beats."""
    gaps = near(df.select(order, micros(ts).alias("us")), lambda w: {"__next": F.lead("us").over(w)}, 0, 1, order)
    beats = F.floor((F.col("__next") - F.col("us") - 1) / idle).cast("long")
    added = spread(gaps.filter(F.col("__next").isNotNull()), F.lit(1), beats, "k").select(order, (F.col("us") + F.col("k") * idle).alias("us"), F.lit(True).alias("beat"))
    return gaps.select(order, "us", F.lit(False).alias("beat")).unionByName(added)


def interrupt_after(df: DataFrame, duration: int, ts="ts") -> DataFrame:
    """The rows of the first `duration` after the earliest row."""
    return with_scalar(df, F.min(micros(ts)), "__t0").filter(micros(ts) < F.col("__t0") + duration).drop("__t0")


def interrupt_when(df: DataFrame, control: DataFrame, flag: Column, order="seq") -> DataFrame:
    """The rows before the first control row whose flag is true; all where none is."""
    stop = control.agg(F.min(F.when(flag, F.col(order))).alias("__stop"))
    return df.crossJoin(F.broadcast(stop)).filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def pause_when(df: DataFrame, control: DataFrame, flag: str, order="seq", key: str | None = None) -> DataFrame:
    """Adds paused (the last control row before is true) and release, the order at which the row goes on: its own, or that of the next false control row, null if there is none."""
    signal = control.select(*([key] if key else []), order, F.col(flag).alias("__flag"), F.lit(True).alias("__control"))
    both = latest(df.withColumn("__control", F.lit(False)).unionByName(signal, allowMissingColumns=True), F.col("__flag"), "__last", order, key)
    resumed = F.when(~F.col("__flag"), -F.col(order))
    ahead = running(both.withColumn("__back", -F.col(order)), resumed, "__next", "max", "__back", key)
    paused = F.coalesce("__last", F.lit(False))
    return ahead.filter("not __control").withColumn("paused", paused).withColumn("release", F.when(paused, -F.col("__next")).otherwise(F.col(order))).drop("__flag", "__control", "__last", "__next", "__back")


def timeout(df: DataFrame, duration: int, ts="ts") -> DataFrame:
    """df, or an error at run time where a row comes later than `duration` after the earliest."""
    rows = with_scalar(df, F.min(micros(ts)), "__t0")
    return rows.filter(F.when(micros(ts) - F.col("__t0") > duration, F.raise_error(F.lit("timed out"))).otherwise(F.lit(True))).drop("__t0")


def hold(df: DataFrame, value: Column, initial, name: str = "held", order="seq", key=None) -> DataFrame:
    """Adds the last defined value, initial before the first. latest() itself is the optional form."""
    return latest(df, value, name, order, key).withColumn(name, F.coalesce(F.col(name), F.lit(initial)))


def hold1(df: DataFrame, value: Column, name: str = "held", order="seq", key=None) -> DataFrame:
    """As latest(), from the first defined value on."""
    return latest(df, value, name, order, key).filter(F.col(name).isNotNull())
