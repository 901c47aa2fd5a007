"""What the operators share: reading tables, shared storage, sizes, and text columns in Arrow batches."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Tasks whose sums the driver adds up itself.
DIRECT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it may be unset, a folder of our own."""
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


def materialise(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and cuts its lineage there, so that lost executors cost nothing.

    Spark deletes the shuffle files of a cut lineage only once the driver's collector finds them dead; an idle driver keeps them for half an hour, so it is asked first.
    """
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Asks the driver's collector, so that the shuffle files of results that were computed and left behind are deleted."""
    spark.sparkContext._jvm.System.gc()


def fresh_folder(spark: SparkSession, what: str) -> str:
    base = shared_dir(spark)
    return f"{base if '://' in base else 'file://' + base}/{what}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Lets Arrow batches hold fewer rows than the default of 10,000, as texts are long; a setting that the user made stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(rows))
    return df


def pieces(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """How many parts of about mb_each MB of stored input the frame makes, by Catalyst's own statistics (no job runs)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / (mb_each * 1e6)))


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, `most` at most: all rows whose count is in the classes of an eighth of a binary order that fit together. Only the classes' sizes, some hundred numbers, come to the driver."""
    size_class = F.floor(F.log2(F.col(count)) * 8)
    sizes = dict(df.filter(F.col(count) > 0).groupBy(size_class.alias("c")).count().collect())
    least, held = None, 0
    for c in sorted(sizes, reverse=True):
        held += sizes[c]
        if held > most:
            break
        least = c
    return df.filter(F.lit(False) if least is None else (F.col(count) > 0) & (size_class >= least))


def added_up(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    keys, inverse = np.unique(at, return_inverse=True)
    return keys, np.bincount(inverse, weights=value, minlength=len(keys))


def task_sums(df: DataFrame, gather, parts: int) -> DataFrame:
    """Rows (part, at, value): of each task at most one for each key modulo `parts`, holding the long keys and doubles that gather(batches) returns for all of the task's rows."""

    def run(batches):
        at, value = gather(batches)
        part = at % parts
        held = np.unique(part).tolist()
        chosen = [np.flatnonzero(part == p) for p in held]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([at[c].tobytes() for c in chosen], pa.binary()), pa.array([value[c].tobytes() for c in chosen], pa.binary())], ["part", "at", "value"])

    return df.mapInArrow(run, "part int, at binary, value binary")


def summed(df: DataFrame, gather, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of what gather(batches) returns for each task, and the sums of their values; tasks' sums are added by part before they come to the driver."""

    def read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return added_up(np.frombuffer(b"".join(rows["at"]), np.int64), np.frombuffer(b"".join(rows["value"]), float))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        at, value = read(rows)
        return pd.DataFrame({"at": [at.tobytes()], "value": [value.tobytes()]})

    return read(task_sums(df, gather, parts).groupBy("part").applyInPandas(add, "at binary, value binary").toPandas())


def tree_summed(df: DataFrame, gather, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """As `summed`, for few keys and a known number of tasks: those of many are added in about the square root of their number of groups, those of at most `DIRECT` come to the driver as they are."""

    def read(at: list[bytes], value: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return added_up(np.frombuffer(b"".join(at), np.int64), np.frombuffer(b"".join(value), float))

    def add(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            more = read(*(c.to_pylist() for c in batch.columns))
            keys, sums = added_up(np.append(keys, more[0]), np.append(sums, more[1]))
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["at", "value"])

    sums = task_sums(df, gather, 1).select("at", "value")
    if tasks > DIRECT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "at binary, value binary")
    got = sums.toPandas()
    return read(list(got["at"]), list(got["value"]))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it often or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def byte_texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about `most` bytes together; a longer text is alone."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield lo, i
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts)
