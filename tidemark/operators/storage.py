"""Storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, on a local master, where it may be unset, a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, named, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, what: str) -> str:
    """The name of a folder below the shared one that nobody has used."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, with its lineage cut there.

    What depends on physical layout, as partition numbers do, is the same for every later reader, and lost executors cost nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once into the shared folder as compressed Parquet, and read from there: for what is wide, and read in parts."""
    df.write.option("compression", "zstd").parquet(path := fresh_folder(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)
