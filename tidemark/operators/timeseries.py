"""Event-time operators over (seq, ts). Durations are in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import near, running, spread, with_index, with_scalar

HOUR = 3_600_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _bucketed(df: DataFrame, period: int, order: str, ts: str) -> DataFrame:
    """Adds __b, the window that a row falls into: windows begin at the first row and go on with the running maximum of time."""
    rows = running(df.withColumn("__us", micros(ts)), F.col("__us"), "__max", "max", order)
    return with_scalar(rows, F.min_by("__us", order), "__t0").withColumn("__b", F.floor((F.col("__max") - F.col("__t0")) / period))


def rate(df: DataFrame, period: int, value: Column, order="seq", ts="ts", name="total") -> DataFrame:
    """(bucket, ts at the window's end, n, total) of tumbling windows anchored at the first row, empty ones too."""
    rows = _bucketed(df, period, order, ts)
    sums = rows.withColumn("__v", value).groupBy("__b").agg(F.count("*").alias("n"), F.sum("__v").alias(name))
    span = rows.agg(F.max("__b").alias("m"), F.min("__t0").alias("t0")).filter("m is not null")
    every = spread(span, F.lit(0), F.col("m"), "bucket").select("bucket", "t0")
    joined = every.join(sums, every["bucket"] == sums["__b"], "left")
    return joined.select("bucket", F.timestamp_micros(F.col("t0") + (F.col("bucket") + 1) * period).alias("ts"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(name, F.lit(0)).alias(name))


def with_rate(df: DataFrame, period: int, value: Column, order="seq", ts="ts", name="total") -> DataFrame:
    """Rates and echoed rows: (bucket, side, seq, ts, v); in order of (bucket, side with R first, seq) a window's sum follows its rows."""
    rows = _bucketed(df, period, order, ts)
    echo = rows.select(F.col("__b").alias("bucket"), F.lit("R").alias("side"), F.col(order).alias(order), F.col(ts).alias("ts"), value.cast("double").alias("v"))
    sums = rate(df, period, value, order, ts, name).select("bucket", F.lit("L").alias("side"), F.lit(None).cast("long").alias(order), "ts", F.col(name).cast("double").alias("v"))
    return echo.unionByName(sums)


def increasing_either(df: DataFrame, order="seq", ts="ts", key=None) -> DataFrame:
    """Adds late: earlier than a row before it."""
    return running(df.withColumn("__us", micros(ts)), F.col("__us"), "__max", "max", order, key).withColumn("late", F.col("__us") < F.col("__max")).drop("__us", "__max")


def increasing(df: DataFrame, order="seq", ts="ts", key=None) -> DataFrame:
    return increasing_either(df, order, ts, key).filter("not late").drop("late")


def reorder_locally(df: DataFrame, over: int, order="seq", ts="ts") -> DataFrame:
    """Adds late: more than `over` behind the running maximum, so that a bounded buffer would have passed it; the others are in order by (ts, seq)."""
    return running(df.withColumn("__us", micros(ts)), F.col("__us"), "__max", "max", order).withColumn("late", F.col("__us") < F.col("__max") - over).drop("__us", "__max")


def interpolate_ticks(df: DataFrame, period: int, value: str, order="seq", ts="ts") -> DataFrame:
    """(ts, is_tick, seq, value): a tick every period after the first row, before a row of the same time, none after the last row. Each gap makes its own ticks."""
    if period < 1000:
        raise ValueError("a period is one millisecond at least")
    rows = with_scalar(df.withColumn("__us", micros(ts)), F.min("__us"), "__t0")
    gaps = near(rows, lambda w: {"__prev": F.lag("__us").over(w)}, 1, 0, order)
    k = lambda c: F.floor((c - F.col("__t0")) / period)
    ticks = spread(gaps.filter(F.col("__prev").isNotNull()).select("__prev", "__us", "__t0"), k(F.col("__prev")) + 1, k(F.col("__us")), "n")
    out = ticks.select(F.timestamp_micros(F.col("__t0") + F.col("n") * period).alias("ts"), F.lit(True).alias("is_tick"), F.lit(None).cast("long").alias(order), F.lit(None).cast(dict(df.dtypes)[value]).alias(value))
    return df.select(F.col(ts).alias("ts"), F.lit(False).alias("is_tick"), F.col(order).cast("long").alias(order), value).unionByName(out)


def throttle(df: DataFrame, factor: float, order="seq", ts="ts") -> DataFrame:
    """Adds emit_after, the seconds after the first row at which a paced replay emits a row."""
    return with_scalar(df, F.min(micros(ts)), "__t0").withColumn("emit_after", (micros(ts) - F.col("__t0")) / 1e6 / factor).drop("__t0")


def drain(df: DataFrame, side: str, column: str = "side") -> DataFrame:
    """Without the rows of a side; ticks, whose side is null, stay."""
    return df.filter(~F.col(column).eqNullSafe(side))


def lift(df: DataFrame, value: str, f) -> DataFrame:
    """Maps values and keeps ticks."""
    return df.withColumn(value, F.when(~F.col("is_tick"), f(F.col(value))))


def now(df: DataFrame, ts="ts") -> DataFrame:
    """Stamps rows with the time at which the query began: one time for all, however often a task runs."""
    return df.withColumn(ts, F.current_timestamp())


def tick(spark: SparkSession, us: int, value_type: str = "double") -> DataFrame:
    """(ts, value): one row without a value at a time."""
    return spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("ts"), F.lit(None).cast(value_type).alias("value"))


def map_value(df: DataFrame, f, value: str = "value") -> DataFrame:
    """Other values at the same times."""
    return df.withColumn(value, f(F.col(value)))


def map_time(df: DataFrame, f, ts="ts") -> DataFrame:
    """The same values at other times; f maps microseconds."""
    return df.withColumn(ts, F.timestamp_micros(f(micros(ts))))


def in_time_order(df: DataFrame, order="seq", ts="ts", name: str = "pos") -> DataFrame:
    """Adds the position by (time, order)."""
    return with_index(df.withColumn("__o", F.struct(micros(ts).alias("us"), order)), "__o", name=name).drop("__o")


def attempt_reorder_locally(df: DataFrame, over: int, order="seq", ts="ts") -> DataFrame:
    """Adds release and pos. A row waits in a buffer until the maximum of time is `over` beyond it; release is the order value of the row that then comes (its own, if it is that late), null if only the end lets it go. Rows leave by (release, time, order), of which pos is the place.

    The maximum only grows, so the row that lets another go is the next one by value: rises of the maximum and deadlines are sorted together and the last rise is carried down. Nothing is simulated row by row.
    """
    rows = running(df.withColumn("__us", micros(ts)), F.col("__us"), "__max", "max", order)
    rises = rows.groupBy("__max").agg(F.min(order).alias("__rise")).select(F.struct((-F.col("__max")).alias("v"), F.lit(0).alias("kind"), F.col("__rise").alias("s")).alias("__o"), "__rise")
    due = rows.drop("__max").withColumn("__o", F.struct((-F.col("__us") - over).alias("v"), F.lit(1).alias("kind"), F.col(order).cast("long").alias("s")))
    both = running(due.unionByName(rises, allowMissingColumns=True).withColumn("__due", F.col("__o.kind") == 1), F.col("__rise"), "__first", "min", "__o").filter("__due")
    let_go = both.withColumn("release", F.when(F.col("__first").isNotNull(), F.greatest(F.col(order), "__first")))
    placed = let_go.withColumn("__p", F.struct(F.col("release").isNull().alias("rest"), "release", "__us", order))
    return with_index(placed, "__p", name="pos").drop("__p", "__o", "__due", "__rise", "__first", "__us")
