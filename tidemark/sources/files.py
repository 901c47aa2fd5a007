"""Files: listing, whole and partial reads, exact lines, and size-bound rotation of text output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pieces
from tidemark.operators.ordered import running
from tidemark.sources import ranges


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and modification time of files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(path, data): the bytes from start to end of each file that has any there, as one value; larger ranges come in pieces from ranges.read."""
    return ranges.read(spark, path, start, end, max(end - start, 1)).select("path", "data")


def read_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, off, data: each file in pieces of size bytes."""
    return ranges.read(spark, path, chunk=size)


def attributes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """walk() with name, extension, folder and is_empty."""
    name = F.element_at(F.split("path", "/"), -1)
    return walk(spark, path, pattern).select("*", name.alias("name"), F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("").alias("extension"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), (F.col("length") == 0).alias("is_empty"))


def read_text(spark: SparkSession, path: str, chunk: int = 1 << 20, span: int = 1 << 27) -> DataFrame:
    """(path, off, text): each file's text by the bytes that it begins at, in pieces that many tasks read; a leading byte-order mark goes."""
    found = pieces.decode_utf8(ranges.read(spark, path, chunk=chunk, span=span), key="path")
    mark = (F.col("off") == 0) & F.startswith("text", F.lit("\ufeff"))
    return found.withColumn("text", F.when(mark, F.col("text").substr(F.lit(2), F.length("text"))).otherwise(F.col("text")))


def read_lines(spark: SparkSession, path: str, chunk: int = 1 << 20, span: int = 1 << 27) -> DataFrame:
    """path, line_no, line by the exact rule, the empty line after a last line end included. Tasks read `span` bytes each, so a large file is no single value and no single task."""
    return pieces.lines(read_text(spark, path, chunk, span), key="path").withColumn("line_no", F.col("line_no").cast("int"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that appear in a folder, as a stream."""
    return spark.readStream.text(folder)


def rotated(df: DataFrame, value: str, limit: int, order: str = "seq", key: str | None = None) -> DataFrame:
    """Adds file, a number that goes up whenever the bytes so far pass a multiple of limit: the part of a rotated log that a row goes to."""
    size = F.coalesce(F.octet_length(value), F.lit(0)) + 1
    return running(df, size, "__b", "sum", order, key).withColumn("file", F.floor((F.col("__b") - size) / limit)).drop("__b")


def write_rotated(df: DataFrame, folder: str, value: str, limit: int, order: str = "seq", key: str | None = None) -> None:
    rotated(df, value, limit, order, key).sortWithinPartitions("file", order).select(F.col(value).alias("value"), "file").write.partitionBy("file").text(folder)


def write_lines(df: DataFrame, folder: str, value: str, order: str = "seq") -> None:
    """Text files whose names follow the order: their lines, file by file, are the values in order, each with a line end. Null is an empty line."""
    df.select(order, F.coalesce(F.col(value), F.lit("")).alias("value")).sort(order).select("value").write.text(folder)


def written(spark: SparkSession, folder: str, name: str = "pos") -> DataFrame:
    """(file, pos, value): the lines that write_lines wrote, with their place in their file."""
    return read_lines(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("line_no").alias(name), F.col("line").alias("value"))


def arrivals(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of each file that appears in a folder, once, as a stream."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
