"""Chunks, runs, sliding windows and splits of an ordered sequence."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.operators import automata
from tidemark.operators.ordered import near, running, with_index, with_scalar
from tidemark.operators.packed import by_steps, offsets, orders, packed, unpacked, with_few
from tidemark.operators.storage import pinned


def chunk_n(df: DataFrame, n: int, order="seq", key=None, partial: bool = True) -> DataFrame:
    """Adds chunk, the number of each group of n neighbours; partial: whether a last shorter one stays."""
    rows = with_index(df, order, key, "__i").withColumn("chunk", F.floor(F.col("__i") / n))
    if partial:
        return rows.drop("__i")
    if key:
        size = rows.groupBy(key, "chunk").count().filter(F.col("count") == n).drop("count")
        return rows.join(size, [key, "chunk"]).drop("__i")
    return with_scalar(rows, F.count("*"), "__n").filter(F.col("chunk") < F.floor(F.col("__n") / n)).drop("__i", "__n")


def group_adjacent_by(df: DataFrame, by: Column, order="seq", key=None) -> DataFrame:
    """Adds run, the number of each maximal run of equal neighbours."""
    begin = near(df.withColumn("__b", by), lambda w: {"__new": F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.lag("__b").over(w).eqNullSafe(F.col("__b")), 1).otherwise(0)}, 1, 0, order, key)
    return running(begin, F.col("__new"), "run", "sum", order, key).withColumn("run", F.col("run") - 1).drop("__b", "__new")


def group_adjacent_by_limit(df: DataFrame, by: Column, limit: int, order="seq", key=None) -> DataFrame:
    """Like group_adjacent_by; runs longer than limit are cut: (run, part) names a group."""
    runs = with_index(group_adjacent_by(df, by, order, key), order, key, "__i")
    first = runs.groupBy(*([key] if key else []), "run").agg(F.min("__i").alias("__first"))
    return runs.join(first, [*([key] if key else []), "run"]).withColumn("part", F.floor((F.col("__i") - F.col("__first")) / limit)).drop("__i", "__first")


def sliding(df: DataFrame, size: int, step: int = 1, order="seq") -> DataFrame:
    """One row per member of each window: window, at (place in it) and df's columns. Every row is dealt to the windows that hold it; the last window may be short."""
    rows = with_scalar(with_index(df, order, name="__i"), F.count("*"), "__n")
    lo = F.greatest(F.lit(0), F.floor((F.col("__i") - size) / step) + 1).cast("long")
    spread = rows.withColumn("window", F.explode(F.filter(F.sequence(lo, F.floor(F.col("__i") / step)), lambda w: (F.col("__i") - w * step >= 0) & (F.col("__i") - w * step < size))))
    alive = (F.col("window") == 0) | ((F.col("window") - 1) * step + size < F.col("__n") if step < size else F.col("window") * step < F.col("__n"))
    return spread.filter(alive).withColumn("at", F.col("__i") - F.col("window") * step).drop("__i", "__n")


def split(df: DataFrame, delimiter: Column, order="seq") -> DataFrame:
    """Adds group, counted by the delimiters before a row; delimiters themselves go. Groups between neighbouring delimiters are empty and have no row."""
    marked = df.withColumn("__d", F.coalesce(delimiter, F.lit(False)).cast("int"))
    return running(marked, F.col("__d"), "group", "sum", order).filter("__d = 0").drop("__d")


def split_sizes(df: DataFrame, delimiter: Column, order="seq") -> DataFrame:
    """(group, n) of all groups, empty ones too; nothing after a last delimiter is no group."""
    marked = df.withColumn("__d", F.coalesce(delimiter, F.lit(False)).cast("int"))
    return running(marked, F.col("__d"), "g", "sum", order).groupBy((F.col("g") - F.col("__d")).alias("group")).agg(F.sum(1 - F.col("__d")).alias("n"))


def zip_with_neighbours(df: DataFrame, value: str, back: bool = True, ahead: bool = True, order="seq", key=None) -> DataFrame:
    """Adds previous and next (value) with has_previous and has_next, which tell an end from a null."""

    def columns(w):
        out = {}
        if back:
            out |= {"previous": F.lag(value).over(w), "has_previous": F.lag(F.lit(True)).over(w).isNotNull()}
        if ahead:
            out |= {"next": F.lead(value).over(w), "has_next": F.lead(F.lit(True)).over(w).isNotNull()}
        return out

    return near(df, columns, int(back), int(ahead), order, key)


def chunk_limit(df: DataFrame, chunk: str, n: int, order="seq") -> DataFrame:
    """Adds part: chunks of more than n rows are cut, small ones never joined; (chunk, part) names a group."""
    return with_index(df, order, chunk, "__i").withColumn("part", F.floor(F.col("__i") / n)).drop("__i")


def buffer_by(df: DataFrame, p: Column, order="seq", key=None) -> DataFrame:
    """Adds block; a new one begins where p stops holding. Rows stay as they are."""
    marked = df.withColumn("__p", F.coalesce(p, F.lit(False)))
    ends = near(marked, lambda w: {"__new": F.when(F.lag("__p").over(w) & ~F.col("__p"), 1).otherwise(0)}, 1, 0, order, key)
    return running(ends, F.col("__new"), "block", "sum", order, key).drop("__p", "__new")


def rechunk_randomly(df: DataFrame, seed: int, mean: int, order="seq", key=None) -> DataFrame:
    """Adds chunk, in groups of `mean` rows on average whose bounds depend on the seed and the order column only, not on partitions."""
    begin = F.when(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(order))), 1, 8), 16, 10).cast("long") % mean == 0, 1).otherwise(0)
    return running(df, begin, "chunk", "sum", order, key)


def scan_chunks(df: DataFrame, chunk: str, value: Column, name: str = "state") -> DataFrame:
    """(chunk, n, total, state): each chunk's number of rows and sum, and the sum of all chunks so far. Rows are added up before chunks are ordered."""
    sums = df.groupBy(chunk).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return running(sums, F.col("total"), name, "sum", chunk)


def chunk_all(df: DataFrame) -> DataFrame:
    """df as a single chunk (chunk 0), said by its number; nothing is brought together."""
    return df.withColumn("chunk", F.lit(0).cast("long"))


def resplit(df: DataFrame, by: str, value: str = "text", order="seq", key: str | None = None, number: str = "k", piece: str = "piece") -> DataFrame:
    """(key, order, k, piece): the texts (of each key) joined in order and split again; a piece goes to the row that ends it, what is left at the end has no row, and is no piece if empty. A null text is empty.

    A delimiter of several characters may lie across rows. What matters of the rows before is how much of a delimiter they end with: a state, of which there are as many as the delimiter has characters, and which automata.entering finds in parallel. What follows then begins with that part of a delimiter and leaves its own to the next.

    All of this is done by runs of neighbouring rows. A run's inner pieces are its own; only the first and the last one may go on in another run. They meet by the number of delimiters before them, which is a running sum over narrow rows.
    """
    if not by:
        raise ValueError("an empty delimiter splits nothing")
    keys = [key] if key else []
    if {number, piece} & {order, *keys}:
        raise ValueError(f"{number} and {piece} must not name the order or the key; choose other names")
    cut = lambda text: F.split(text, re.escape(by), -1)

    def held(text: Column) -> Column:
        """Characters of an unfinished delimiter at the end of text, which begins inside none."""
        rest = F.element_at(cut(text), -1)
        return F.coalesce(*[F.when(F.endswith(rest, F.lit(by[:k])), k) for k in range(len(by) - 1, 0, -1)], F.lit(0))

    runs = packed(df.filter(F.length(value) > 0).select(*keys, order, value), keys, order, value)
    kind = runs.schema["__lo"].dataType
    here = F.struct(*keys, F.col("__lo").alias(order))
    if len(by) == 1:
        told = runs.withColumns({"__enters": F.lit(0), "__leaves": F.lit(0)})
    else:
        own = F.col("__value").cast("string")
        placed = automata.numbered(runs.select(*keys, "__lo", F.array(*[held(F.concat(F.lit(by[:k]), own)) for k in range(len(by))]).alias("__f")), "__lo", key)
        states = placed.join(automata.entering(placed, len(by)), "__i").select(here.alias("__at"), "__enters", F.element_at("__f", F.col("__enters") + 1).alias("__leaves"))
        told = with_few(runs.withColumn("__o", here), states.filter("__enters > 0 or __leaves > 0"), F.col("__o").eqNullSafe(F.col("__at"))).drop("__o", "__at").na.fill(0, ["__enters", "__leaves"])
    part = StructType([StructField("p", StringType()), StructField("o", kind), StructField("k", IntegerType())])
    parts = unpacked(told.drop("__hi"), [*[(k, runs.schema[k].dataType) for k in keys], ("__lo", kind), ("__parts", ArrayType(part))], _parts(by, keys, by_steps(kind)))
    end = lambda x: F.when(x["k"].isNotNull(), F.struct(*keys, x["o"].alias(order)))
    whole = parts.select(here.alias("__o"), F.transform("__parts", lambda x: F.struct(x["p"].alias("p"), end(x).alias("end"), x["k"].alias("k"))).alias("__parts"))
    rows = told.select(here.alias("__o"), "__leaves")
    tails = None
    if len(by) > 1:  # what the last row of all, or of a key, leaves is no delimiter
        ends = rows.groupBy(*[F.col(f"__o.{c}").alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.max("__o").alias("__last"), F.max_by("__leaves", "__o").alias("__leaves"))
        tails = ends.filter("__leaves > 0").select("__last", F.lit(by).substr(F.lit(1), F.col("__leaves")).alias("__p"))
    met = meeting(whole, keys, tails).filter(F.col("__end").isNotNull() | (F.col("__p") != ""))
    return met.select(*[F.col(f"__any.{c}").alias(c) for c in keys], F.col(f"__end.{order}").alias(order), F.col("__k").alias(number), F.col("__p").alias(piece))


def _parts(by: str, keys: list[str], whole: bool):
    """Makes __parts from batches of runs with __enters and __leaves: each part with the order of the row in which the delimiter after it ends, and its number there; both null for the last part."""
    cut = by.encode()
    led = [by[:k].encode() for k in range(len(by))]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        listed, value = batch.column("__sizes"), batch.column("__value").to_pylist()
        bounds = offsets(listed) - offsets(listed)[0]
        sizes = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        parts, at, of, begins = [], [], [], [0]
        for k, (data, enters, leaves) in enumerate(zip(value, batch.column("__enters").to_pylist(), batch.column("__leaves").to_pylist(), strict=True)):
            mine = (led[enters] + data).split(cut)
            mine[-1] = mine[-1][: len(mine[-1]) - len(led[leaves])]
            ends = np.cumsum([len(p) + len(cut) for p in mine[:-1]], dtype=np.int64) - len(led[enters]) - 1
            row = np.searchsorted(np.cumsum(sizes[bounds[k] : bounds[k + 1]]), ends, "right")
            at += [*(row + bounds[k]).tolist(), None]
            of += [*(np.arange(len(row)) - np.searchsorted(row, row, "left")).tolist(), None]
            parts += mine
            begins.append(len(parts))
        held = pa.StructArray.from_arrays([pa.array(parts, pa.binary()).cast(pa.string()), orders(batch, whole).take(pa.array(at, pa.int64())), pa.array(of, pa.int32())], ["p", "o", "k"])
        return [*[batch.column(c) for c in (*keys, "__lo")], pa.ListArray.from_arrays(pa.array(begins, pa.int32()), held)]

    return run


def meeting(rows: DataFrame, keys: list[str], tails: DataFrame | None = None, indexed: bool = False) -> DataFrame:
    """Parts of rows' texts, the last part of a row going on in the first of the next one (of its key). rows: __o, a struct of the keys and an order, and __parts, texts or structs of a text p, the __o `end` that ends it, and its number k there (those of the row itself, if texts). tails: __last, the __o of a row, and __p, text that follows it.

    Returns __any, the __o of a row of the part; __end, that of the row that ends it (null where no row does); __k, its number among the parts of that row; __p; and, if indexed, __index, its number among the parts of its key.
    """
    narrow = rows.select("__o", (F.size("__parts") - 1).cast("long").alias("__n"))
    upto = running(narrow, F.col("__n"), "__upto", "sum", "__o")
    counted = pinned(upto.select(F.col("__o").alias("__at"), (F.col("__upto") - F.col("__n")).alias("__before"), F.col("__upto").alias("__upto")))
    parts = rows.join(counted.select("__at", "__before"), F.col("__o").eqNullSafe(F.col("__at"))).drop("__at") if indexed else rows.withColumn("__before", F.lit(None).cast("long"))
    told = isinstance(rows.schema["__parts"].dataType.elementType, StructType)
    parts = parts.withColumn("__size", F.size("__parts")).select("__o", "__before", "__size", F.posexplode("__parts").alias("__at", "__x"))
    parts = parts.select("__o", "__before", "__size", "__at", *([F.col("__x.p").alias("__p"), F.col("__x.end").alias("__end"), F.col("__x.k").alias("__k")] if told else [F.col("__x").alias("__p"), F.col("__o").alias("__end"), F.col("__at").alias("__k")]))
    inner = parts.filter("__at > 0 and __at < __size - 1").select(F.col("__o").alias("__any"), "__end", "__k", "__p", (F.col("__before") + F.col("__at")).alias("__index"))
    edge = parts.filter("__at = 0 or __at = __size - 1").withColumnRenamed("__at", "__place")
    if not indexed:
        edge = edge.drop("__before").join(counted, F.col("__o").eqNullSafe(F.col("__at")))
    edge = edge.select("__o", (F.col("__before") + F.col("__place")).alias("__number"), F.when((F.col("__place") == 0) & (F.col("__size") > 1), F.col("__end")).alias("__end"), "__p", F.lit(0).alias("__after"))
    if tails is not None:
        edge = edge.unionByName(tails.join(counted, F.col("__last").eqNullSafe(F.col("__at"))).select(F.col("__last").alias("__o"), F.col("__upto").alias("__number"), F.lit(None).cast(rows.schema["__o"].dataType).alias("__end"), "__p", F.lit(1).alias("__after")))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__after").alias("a"), F.col("__p").alias("p"))))
    of_key = [F.col(f"__o.{c}").alias(f"__k{i}") for i, c in enumerate(keys)]
    joined = edge.groupBy(*of_key, "__number").agg(F.max("__o").alias("__any"), F.max("__end").alias("__end"), F.array_join(F.transform(in_order, lambda x: x["p"]), "").alias("__p"))
    out = inner.unionByName(joined.select("__any", "__end", F.lit(0).alias("__k"), "__p", F.col("__number").alias("__index")))
    if not indexed:
        return out.drop("__index")
    if not keys:
        return out
    first = counted.groupBy(*[F.col(f"__at.{c}").alias(f"__f{i}") for i, c in enumerate(keys)]).agg(F.min("__before").alias("__first"))
    same = [F.col(f"__any.{c}").eqNullSafe(F.col(f"__f{i}")) for i, c in enumerate(keys)]
    return out.join(first, same).withColumn("__index", F.col("__index") - F.col("__first")).drop("__first", *[f"__f{i}" for i in range(len(keys))])
