"""Ordered computations per group that don't put a large group into one task.

Rows are range-partitioned by group and order; each chunk also gets the last and
the first ``k`` rows of its neighbours in the group (a halo).  Windows then run
within (group, chunk).  Running sums add what the earlier chunks of the group sum
to, which is one number a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ordered_chunks, partitions

_LEAST_ROWS = 256  # a chunk inside a group must hold at least the halo's rows


def sliced(df: DataFrame, group: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` in ordered chunks (column ``chunk``); ``group`` and ``order`` must give a total order.

    The rows are worked out once: counting, sampling the ranges and sorting read
    them from where executors keep them (what is lost with one is worked out again).
    """
    kept = df.persist()
    n = chunks or max(1, min(partitions(df.sparkSession), kept.count() // _LEAST_ROWS))
    out = ordered_chunks(kept, group, *order, n=n)
    kept.unpersist()
    return out


def with_halo(chunked: DataFrame, group: str, order: list[str], k: int = 1) -> DataFrame:
    """Each (group, chunk) with ``k`` rows of the group's chunk before and after it (``halo`` true)."""
    parts = chunked.select(group, "chunk").distinct()
    w = W.partitionBy(group).orderBy("chunk")  # one row a chunk
    near = parts.select(F.col(group).alias("__fw_g"), F.col("chunk").alias("__fw_c"), F.lag("chunk").over(w).alias("__fw_before"), F.lead("chunk").over(w).alias("__fw_after"))
    inside = W.partitionBy(group, "chunk")
    marked = chunked.withColumn("__fw_first", F.row_number().over(inside.orderBy(*order))).withColumn("__fw_last", F.row_number().over(inside.orderBy(*[F.desc(o) for o in order])))
    own = marked.drop("__fw_first", "__fw_last").withColumn("halo", F.lit(False))
    edge = marked.where((F.col("__fw_first") <= k) | (F.col("__fw_last") <= k)).join(near, F.col(group).eqNullSafe(F.col("__fw_g")) & (F.col("chunk") == F.col("__fw_c")))
    to = F.explode(F.array_compact(F.array(F.when(F.col("__fw_first") <= k, F.col("__fw_before")), F.when(F.col("__fw_last") <= k, F.col("__fw_after"))))).alias("__fw_to")
    halo = edge.select(*chunked.columns, to).drop("chunk").withColumnRenamed("__fw_to", "chunk").withColumn("halo", F.lit(True))
    return own.unionByName(halo)


def neighbours(chunked: DataFrame, group: str, order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Every row with the values of the row before it in its group (null for the first)."""
    w = W.partitionBy(group, "chunk").orderBy(*order)
    wide = with_halo(chunked, group, order)
    for x in columns:
        wide = wide.withColumn(prefix + x, F.lag(x).over(w))
    return wide.where(~F.col("halo")).drop("halo")


def running_sum(chunked: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Every row with the sum of ``value`` from the start of its group up to and including it."""
    valued = chunked.withColumn("__fw_v", value)
    sums = valued.groupBy(group, "chunk").agg(F.sum("__fw_v").alias("__fw_s"))
    before = sums.select(F.col(group).alias("__fw_g"), F.col("chunk").alias("__fw_c"), F.coalesce(F.sum("__fw_s").over(W.partitionBy(group).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__fw_before"))
    local = F.sum("__fw_v").over(W.partitionBy(group, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = valued.withColumn("__fw_local", local).join(before, F.col(group).eqNullSafe(F.col("__fw_g")) & (F.col("chunk") == F.col("__fw_c")))
    return out.withColumn(name, F.col("__fw_local") + F.col("__fw_before")).drop("__fw_v", "__fw_local", "__fw_before", "__fw_g", "__fw_c")
