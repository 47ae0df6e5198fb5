"""Connected components of a graph given as a table of links, by alternating large and small stars.

A large star links each node's larger neighbours to the smallest node it sees, a small star its smaller ones. Either is
one aggregation (combined before the shuffle) and one join on the node, which adaptive execution splits where a node
holds very many links. Every round is a table in the shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b, of one star operation."""
    if large:
        near = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        near = links.toDF("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    joined = near.join(least, near["u"] == least["w"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w"), F.col("m")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root) of every node with a link; root is the smallest node that it reaches."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = written(_star(_star(now, True), False), "links")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b"))).distinct()
