"""Prefixes, suffixes, tests and element-wise selection. A null predicate counts as false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import near, window, with_index, with_scalar


def true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _cut(df: DataFrame, p: Column, keep: Callable[[Column, Column], Column], order: str, key: str | None) -> DataFrame:
    """Rows kept by comparing their order with that of the first row where p fails."""
    first = F.min(F.when(~true(p), F.col(order)))
    marked = df.withColumn("__stop", first.over(window(order, key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) if key else with_scalar(df, first, "__stop")
    return marked.filter(keep(F.col(order), F.col("__stop"))).drop("__stop")


def take_while(df, p, order="seq", key=None):
    return _cut(df, p, lambda s, x: x.isNull() | (s < x), order, key)


def take_through(df, p, order="seq", key=None):
    """Like take_while, with the first row that fails."""
    return _cut(df, p, lambda s, x: x.isNull() | (s <= x), order, key)


def drop_while(df, p, order="seq", key=None):
    return _cut(df, p, lambda s, x: s >= x, order, key)


def drop_through(df, p, order="seq", key=None):
    """Like drop_while, without the first row that fails."""
    return _cut(df, p, lambda s, x: s > x, order, key)


def take(df, n: int, order="seq"):
    return df.orderBy(order).limit(n)


#: Up to so many rows an end is found by a top-k pass over the order column; further in, by positions.
NEAR_END = 10_000


def _beyond(df, n: int, order: str, least: bool):
    """df with __end, the order value of the n-th row from an end (of the farthest one, if there are fewer)."""
    ends = df.select(order).orderBy(F.col(order) if least else F.col(order).desc()).limit(max(n, 0))
    return with_scalar(df, (F.max if least else F.min)(order), "__end", ends)


def _by_bound(df, n: int, order: str, least: bool) -> bool:
    """Whether comparing orders tells the n rows at an end from the rest: they lie near it, and exactly n have an order up to that of the n-th. Otherwise positions do, in the order of the other columns where orders are equal."""
    if n > NEAR_END:
        return False
    inside = F.col(order).isNull() | (F.col(order) <= F.col("__end")) if least else F.col(order) >= F.col("__end")
    return _beyond(df, n, order, least).filter(F.col("__end").isNotNull() & inside).count() == n


def _positions(df, order: str) -> DataFrame:
    """df with positions __i; rows of equal order stand in the order of their other columns."""
    others = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c) for c, t in df.dtypes if c != order]
    return with_index(df, [F.col(order), *others], name="__i")


def drop(df, n: int, order="seq"):
    if n <= 0:
        return df
    if not _by_bound(df, n, order, True):
        return _positions(df, order).filter(F.col("__i") >= n).drop("__i")
    return _beyond(df, n, order, True).filter(F.col(order) > F.col("__end")).drop("__end")


def tail(df, order="seq"):
    return drop(df, 1, order)


def take_right(df, n: int, order="seq"):
    return df.orderBy(F.col(order).desc()).limit(n)


def drop_right(df, n: int, order="seq"):
    if n <= 0:
        return df
    if _by_bound(df, n, order, False):
        return _beyond(df, n, order, False).filter(F.col(order).isNull() | (F.col(order) < F.col("__end"))).drop("__end")
    rows = _positions(df, order)
    return with_scalar(rows, F.count("*"), "__n").filter(F.col("__i") < F.col("__n") - n).drop("__i", "__n")


def drop_last_if(df, p, order="seq"):
    marked = with_scalar(df, F.max_by(F.struct(F.col(order).alias("s"), true(p).alias("p")), F.col(order)), "__last")
    return marked.filter(~(F.col("__last.p") & (F.col(order) == F.col("__last.s")))).drop("__last")


def head(df, order="seq"):
    return take(df, 1, order)


def last(df, order="seq"):
    return take_right(df, 1, order)


def last_or(df, fallback: dict, order="seq"):
    return if_empty_emit(last(df, order), fallback)


def limit(df, n: int):
    """df, or an error at run time where it has more than n rows."""
    return with_scalar(df, F.count("*"), "__n").filter(F.when(F.col("__n") > n, F.raise_error(F.lit(f"more than {n} rows"))).otherwise(F.lit(True))).drop("__n")


def delete_first(df, p, order="seq"):
    return with_scalar(df, F.min(F.when(true(p), F.col(order))), "__hit").filter(F.col("__hit").isNull() | (F.col(order) != F.col("__hit"))).drop("__hit")


def find(df, p, order="seq"):
    return df.filter(true(p)).orderBy(order).limit(1)


def collect_first(df, value: Column, name: str, order="seq"):
    """The first defined value of a partial function, null meaning undefined."""
    return df.select(order, value.alias(name)).filter(F.col(name).isNotNull()).orderBy(order).limit(1)


def collect_while(df, value: Column, name: str, order="seq"):
    return take_while(df.withColumn(name, value), F.col(name).isNotNull(), order)


def collect(df, value: Column, name: str):
    return df.withColumn(name, value).filter(F.col(name).isNotNull())


def filter_not(df, p):
    return df.filter(~true(p))


def exists(df, p, name="result"):
    return df.agg(F.coalesce(F.bool_or(true(p)), F.lit(False)).alias(name))


def forall(df, p, name="result"):
    return df.agg(F.coalesce(F.bool_and(true(p)), F.lit(True)).alias(name))


def changes_by(df, value: Column, order="seq", key=None):
    """Rows whose value differs from that of the row before; nulls equal nulls."""
    marked = near(df.withColumn("__v", value), lambda w: {"__first": F.lag(F.lit(1)).over(w).isNull(), "__same": F.lag("__v").over(w).eqNullSafe(F.col("__v"))}, 1, 0, order, key)
    return marked.filter("__first or not __same").drop("__v", "__first", "__same")


def if_empty(df, other: DataFrame):
    empty = df.limit(1).agg((F.count("*") == 0).alias("__empty"))
    return df.unionByName(other.crossJoin(F.broadcast(empty)).filter("__empty").drop("__empty"))


def if_empty_emit(df, row: dict):
    values = [F.lit(row.get(c)).cast(t).alias(c) for c, t in df.dtypes]
    return if_empty(df, df.sparkSession.range(1).select(*values))


def intersperse(df, row: dict, order="seq"):
    """A separator between neighbours; pos is the place in the result."""
    rows = with_index(df, order, name="__i")
    sep = rows.filter("__i > 0").select(*[F.lit(row.get(c)).cast(t).alias(c) for c, t in df.dtypes], (2 * F.col("__i") - 1).alias("pos"))
    return rows.withColumn("pos", 2 * F.col("__i")).drop("__i").unionByName(sep)


def append(*parts: DataFrame, order="seq"):
    """All rows of one part after those of the part before: (part, order) is the new order."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def repeat_n(df, n: int):
    """df n times in a row: (turn, order) is the new order."""
    return df.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("turn", F.lit(0)).limit(0)


def none_terminate(df, order="seq"):
    """Wraps rows as defined elements and ends with an undefined one."""
    cols = [c for c in df.columns if c != order]
    end = df.agg(F.max(order).alias("m")).select(F.coalesce(F.col("m") + 1, F.lit(0)).alias(order), F.lit(False).alias("defined"))
    return df.withColumn("defined", F.lit(True)).unionByName(end, allowMissingColumns=True).select(order, *cols, "defined")


def un_none(df, value: str):
    return df.filter(F.col(value).isNotNull())


def un_none_terminate(df, value: str, order="seq"):
    return take_while(df, F.col(value).isNotNull(), order)


def drop_last(df, order="seq"):
    return drop_right(df, 1, order)


def cons(df, row: dict, order="seq"):
    """A row before all others, placed one below the least order value."""
    first = df.agg(F.min(order).alias("__m"))
    made = first.select(*[(F.coalesce(F.col("__m") - 1, F.lit(0)) if c == order else F.lit(row.get(c))).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(made)


def last_option(df, order="seq"):
    """One row always: the last one with found true, or nulls with found false."""
    return if_empty_emit(last(df, order).withColumn("found", F.lit(True)), {"found": False})


def or_error(df, message: str):
    """df, or an error at run time where it has no row: head(df) or last(df) that must exist."""
    none = df.limit(1).agg(F.count("*").alias("__n")).filter(F.when(F.col("__n") == 0, F.raise_error(F.lit(message))).otherwise(F.lit(False)))
    return df.unionByName(none.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


def uncons_n(df, n: int, order="seq"):
    """Adds in_head: among the first n rows. One pass gives the head and the rest."""
    if n <= 0:
        return df.withColumn("in_head", F.lit(False))
    if not _by_bound(df, n, order, True):
        return _positions(df, order).withColumn("in_head", F.col("__i") < n).drop("__i")
    return _beyond(df, n, order, True).withColumn("in_head", F.col(order).isNull() | (F.col(order) <= F.col("__end"))).drop("__end")
