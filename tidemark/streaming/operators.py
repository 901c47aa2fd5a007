"""Structured Streaming forms: event-time rates, late tags, debounce and size-or-time groups, and fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import Debounce, GroupWithin, run_stream


def windowed_rate(df: DataFrame, ts: str, period: str, value: Column, late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Sums per event-time window once the watermark has passed it; rows later than that are dropped, so state is bounded."""
    keys = [key] if key else []
    return df.withWatermark(ts, late).groupBy(F.window(ts, period), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select("window.*", *keys, "total", "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select("session_window.*", key, "n")


def distinct_within(df: DataFrame, ts: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(columns)


def debounce(df: DataFrame, key: str, wait: int, schema: str) -> DataFrame:
    """Columns key, seq, us and value; see scans.Debounce. The last row of a span is out when the next span begins."""
    return run_stream(df, Debounce(wait), schema, key)


def group_within(df: DataFrame, key: str, size: int, wait: int, schema: str) -> DataFrame:
    return run_stream(df, GroupWithin(size, wait), schema, key)


def broadcast_through(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every branch over the same input, results together."""
    out = None
    for b in branches:
        out = b(df) if out is None else out.unionByName(b(df))
    return out


def fan_out(df: DataFrame, *sinks: Callable[[DataFrame, int], None]):
    """One stream, several sinks: each micro-batch is held once and given to all."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for s in sinks:
                s(held, number)
        finally:
            held.unpersist()

    return df.writeStream.foreachBatch(each)
