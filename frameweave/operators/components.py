"""Connected components by hooking to the smallest neighbour and contracting.

Each round every vertex hooks to its smallest neighbour, the chains are jumped to
their roots (four links a pass, doubling), and the edges are contracted to edges
between roots.  Each round at least halves the vertices that still have edges, so
there are at most log2(n) rounds; the edges shrink with them.  Only minima are
aggregated (combined before the shuffle), no neighbour list is ever built, and
each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_step, merge_join


def _twice(parents: DataFrame) -> DataFrame:
    """``node, parent`` with every vertex moved on to its parent's parent."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return merge_join(parents, up, "parent").select("node", F.col("grand").alias("parent"))


def _jump(parents: DataFrame) -> DataFrame:
    """Every vertex with its root; two doublings a pass, until a pass moves nothing."""
    while True:
        twice = _twice(parents)
        up = twice.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut_step(merge_join(twice, up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, label`` of every vertex in an edge; the label is the component's smallest vertex.

    Edges with a null end are ignored; an edge from a vertex to itself makes it a
    component of its own; repeated edges and either direction are the same edge.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    links = cut_step(pairs.union(pairs.select("v", "u")).distinct())
    maps: list[DataFrame] = []
    while True:
        low = links.groupBy("u").agg(F.min("v").alias("v"))
        roots = _jump(low.select(F.col("u").alias("node"), F.least("u", "v").alias("parent")))
        maps.append(roots)
        at_u = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        at_v = roots.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        links = cut_step(merge_join(merge_join(links, at_u, "u"), at_v, "v").where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        if links.isEmpty():
            break
    label = maps[-1]
    for lower in reversed(maps[:-1]):
        up = label.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        label = merge_join(lower, up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    return label.select("node", F.col("parent").alias("label"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a side with hot keys to one with few rows a key: hot keys are spread over ``salts`` tasks."""
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("bigint"))
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return merge_join(b, s, [*on, "_salt"], how).drop("_salt")
