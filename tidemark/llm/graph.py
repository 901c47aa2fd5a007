"""Connected components of a link table, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Links of a task of a step.
TASK_LINKS = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids to (node, component), component the smallest id reachable; nodes without links don't appear.

    Each step turns every node's links towards its smallest neighbour; the least is summed map-side first, so a hub costs a row per task. Steps end when the links are stars around their smallest nodes, which links of copies to their first often are from the start. The number of rounds grows as the logarithm of the longest chain. Nulls and self-links are dropped; an empty table gives an empty one.
    """
    least_tasks = links.sparkSession.sparkContext.defaultParallelism
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        n, crossed = _size_and_crossings(edges)
        edges = edges.coalesce(max(least_tasks, math.ceil(n / TASK_LINKS)))
        if not crossed:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _size_and_crossings(edges: DataFrame) -> tuple[int, int]:
    """The number of links (u, v), u > v, and of nodes that keep them from being stars around smallest nodes: nodes with two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    n, crossed = nodes.agg(F.sum("smaller"), F.count_if(F.expr("smaller > 0 and smaller + larger > 1"))).first()
    return n or 0, crossed
