"""Positional and temporal pairing of sequences. Pairs meet in an equi-join on position, so both sides are dealt by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running, upto, with_index


def _two(left: DataFrame, right: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    a = with_index(left, order, name="pos").select("pos", F.struct(*left.columns).alias("l"))
    return a, with_index(right, order, name="pos").select("pos", F.struct(*right.columns).alias("r"))


def zip_rows(left: DataFrame, right: DataFrame, order="seq") -> DataFrame:
    """(pos, l, r) of rows at the same position, as far as the shorter goes."""
    a, b = _two(left, right, order)
    return a.join(b, "pos")


def zip_all(left: DataFrame, right: DataFrame, order="seq") -> DataFrame:
    """(pos, l, r, has_l, has_r) as far as the longer goes; flags tell a missing row from one of nulls."""
    a, b = _two(left, right, order)
    return a.withColumn("has_l", F.lit(True)).join(b.withColumn("has_r", F.lit(True)), "pos", "full").fillna(False, ["has_l", "has_r"])


def interleave_all(left: DataFrame, right: DataFrame, order="seq") -> DataFrame:
    """Rows in turns, then the rest of the longer; pos is the place in the result."""
    a, b = with_index(left, order, name="__i").withColumn("side", F.lit(0)), with_index(right, order, name="__i").withColumn("side", F.lit(1))
    both = a.unionByName(b)
    n = both.groupBy().agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("n0"), F.sum("side").alias("n1"))
    least = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    place = F.when(F.col("__i") < least, 2 * F.col("__i") + F.col("side")).otherwise(F.col("__i") + least)
    return both.crossJoin(F.broadcast(n)).withColumn("pos", place).drop("__i", "n0", "n1")


def interleave(left: DataFrame, right: DataFrame, order="seq") -> DataFrame:
    """Rows in turns while both have one."""
    a, b = with_index(left, order, name="__i").withColumn("side", F.lit(0)), with_index(right, order, name="__i").withColumn("side", F.lit(1))
    pairs = a.select("__i").join(b.select("__i"), "__i")
    return a.unionByName(b).join(pairs, "__i", "left_semi").withColumn("pos", 2 * F.col("__i") + F.col("side")).drop("__i")


def interleave_ordered(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """The merge of two sequences that are sorted by value; of equals the left one comes first."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return with_index(both.withColumn("__o", F.struct(value, "side", *[c for c in left.columns if c != value])), "__o", name="pos").drop("__o")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both, tagged by side; event order is the order column's."""
    return left.withColumn("side", F.lit("L")).unionByName(right.withColumn("side", F.lit("R")), allowMissingColumns=True)


def merge_halt(left: DataFrame, right: DataFrame, order="seq", halt="both") -> DataFrame:
    """The merge, cut after the last row of the side (L, R, or of whichever ends first) that halts it."""
    both = merge(left, right)
    ends = both.groupBy("side").agg(F.max(order).alias("end"))
    stop = ends.filter(F.lit(True) if halt == "both" else F.col("side") == halt).agg(F.min("end").alias("__stop"))
    return both.crossJoin(F.broadcast(stop)).filter(F.col(order) <= F.col("__stop")).drop("__stop")


def latest(df: DataFrame, value: Column, name: str, order="seq", key: str | None = None) -> DataFrame:
    """Adds the last defined value so far (a held signal). Without a key it is a running maximum of (order, value), which needs no single task; value is of an orderable type then."""
    if key:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(order, key)))
    rows = df.withColumn("__h", value)
    return running(rows, F.when(F.col("__h").isNotNull(), F.struct(order, "__h")), "__l", "max", order).withColumn(name, F.col("__l.__h")).drop("__h", "__l")


def switch_map(outer: DataFrame, inner: DataFrame, order="seq", key: str | None = None) -> DataFrame:
    """Inner rows, each with the outer row that is current then; those before any outer row are gone. A union and a held value, not a range join."""
    cols = [c for c in outer.columns if c != key]
    a = outer.select(*([key] if key else []), F.struct(F.col(order).alias("o"), F.lit(0).alias("side")).alias("__o"), F.struct(*cols).alias("__outer"))
    b = inner.select(*inner.columns, F.struct(F.col(order).alias("o"), F.lit(1).alias("side")).alias("__o"))
    both = latest(b.unionByName(a, allowMissingColumns=True), F.col("__outer"), "outer", "__o", key)
    return both.filter("__o.side = 1 and outer is not null").drop("__o", "__outer")


def zip_right(left: DataFrame, right: DataFrame, order="seq") -> DataFrame:
    """The rows of right that have a counterpart."""
    return zip_rows(left, right, order).select("r.*")


def par_join(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all frames, tagged by name; Spark runs their tasks side by side."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def get_and_updates(df: DataFrame, at, order="seq") -> DataFrame:
    """What a held signal is at an order value, its last row up to there (part 0), and the rows after it (part 1)."""
    current = df.filter(F.col(order) <= at).orderBy(F.col(order).desc()).limit(1)
    return current.withColumn("part", F.lit(0)).unionByName(df.filter(F.col(order) > at).withColumn("part", F.lit(1)))
