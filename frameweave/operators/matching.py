"""Cascading record matching (J13) and index merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import file_name, match_path, match_stem

LEVELS = ("path", "checksum", "filename", "stem")
EXPOSED = 25


def _level(outputs: DataFrame, items: DataFrame, key_out: Column, key_item: Column, level: str) -> DataFrame:
    """Candidates of one level: how many, the smallest, and up to 25 ids.

    Only the 25 smallest ids a key are kept, so a common name is bounded.
    """
    from pyspark.sql import Window as W

    keyed = items.select(key_item.alias("_k"), "item_id").where("_k is not null and _k != ''").distinct()
    few = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("item_id"))).where(F.col("_r") <= EXPOSED)
    n = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    per = few.groupBy("_k").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).join(n, "_k")
    return outputs.withColumn("_k", key_out).join(per, "_k").select("output_id", F.struct(F.lit(level).alias("level"), "n", "ids").alias(f"_{level}"))


def cascade_match(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Each output's match: the first level with any candidate decides.

    ``outputs``: ``output_id, path, checksum``; ``items``: ``item_id, path,
    checksum``.  One candidate is a match, more are ambiguous; only exact levels
    (path, checksum) link automatically.
    """
    keys = {
        "path": (match_path("path"), match_path("path")), "checksum": (F.col("checksum"), F.col("checksum")),
        "filename": (F.lower(file_name("path")), F.lower(file_name("path"))), "stem": (match_stem(file_name("path")), match_stem(file_name("path"))),
    }
    out = outputs
    for level, (a, b) in keys.items():
        out = out.join(_level(outputs, items, a, b, level), "output_id", "left")
    hit = F.coalesce(*[f"_{x}" for x in LEVELS])
    out = out.select("output_id", hit.alias("h"))
    state = F.when(F.col("h").isNull(), "unmatched").when(F.col("h.n") > 1, "ambiguous").when(F.col("h.level").isin("path", "checksum"), "linked").otherwise("suggested")
    return out.select("output_id", F.col("h.level").alias("level"), F.coalesce("h.n", F.lit(0)).alias("n_candidates"), F.array_join("h.ids", ",").alias("candidates"), state.alias("state"))


def merge_index(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """What a new scan does to an index: reused, changed, new or unavailable (never deleted)."""
    a = old.select(F.col(key), F.struct(*compare).alias("_old"))
    b = new.select(F.col(key), F.struct(*compare).alias("_new"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "unavailable").when(F.col("_old").eqNullSafe(F.col("_new")), "reused").otherwise("changed")
    return both.select(key, status.alias("status"))
