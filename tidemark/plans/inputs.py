"""Tables as ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """events with seq for event_id and only the columns asked for."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), *columns)


def of_type(spark: SparkSession, sf_dir: str, kind: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias("seq"), *columns)
