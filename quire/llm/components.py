"""Connected components of a graph given as edges, by alternating stars.

Each round hangs a node's larger neighbours on its smallest one, then its
smaller neighbours on the smallest of those; edges that already form stars no
longer change. The number of rounds grows as the logarithm of the longest chain.
Minima are taken by aggregation, so a node with very many edges is summed up
map-side first and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v").select("u", "v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): every node that has an edge to another, and the least node it reaches.

    ``edges`` has long columns u and v in any order; loops and repeats are allowed,
    rows with a null are left out. No edges give no rows.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = written(now.distinct(), "edges")
    before = _state(now)
    while before[0]:
        now = written(_small_star(_large_star(now)), "edges")
        state = _state(now)
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
