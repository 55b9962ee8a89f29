"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node whose component has a smaller node.

    ``edges``: (u, v) longs in any direction; loops and repeats are fine.
    Each round links every neighbour of a node to the smallest one around it
    (first the larger, then the smaller neighbours), so the paths shrink by
    halves; it stops when the edges no longer change.  A round is two
    aggregations and two joins on node ids, written in the shared folder; a
    hub's rows meet one row of minima, which a skewed join splits.
    """
    e = scratch.put(edges.filter("u != v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                    f"{name}-0")
    k, mark = 0, _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct(), f"{name}-large-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = scratch.put(small, f"{name}-{k + 1}")
        scratch.drop(f"{name}-large-{k}", f"{name}-{k}")
        k, last, mark = k + 1, mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
