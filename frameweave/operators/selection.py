"""Selection rules, manifests and copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import sanitize_component
from .ordered import running_sum, sliced


@dataclass(frozen=True)
class Rules:
    asset_ids: Sequence[str] = ()
    decisions: Sequence[str] = ()
    least_rating: int | None = None
    starred_only: bool = False
    moment_ids: Sequence[str] = ()

    def predicate(self) -> Column:
        """P5: all given rules hold; a null value fails its rule."""
        parts = [F.lit(True)]
        if self.asset_ids:
            parts.append(F.col("asset_id").isin(list(self.asset_ids)))
        if self.decisions:
            parts.append(F.col("decision").isin(list(self.decisions)))
        if self.least_rating is not None:
            parts.append(F.col("rating") >= self.least_rating)
        if self.starred_only:
            parts.append(F.col("starred"))
        if self.moment_ids:
            parts.append(F.col("moment_id").isin(list(self.moment_ids)))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def select_assets(assets: DataFrame, rules: Rules, collection: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The rules within a collection, then overrides: excluded ones leave, included ones come whatever the rules.

    No collection means all assets; an empty one selects nothing.  ``overrides``
    has ``asset_id, kind, seq``; of several for an asset the last counts.
    """
    hit = rules.predicate()
    out = assets
    if collection is not None:
        out = out.join(collection.select("asset_id", F.lit(True).alias("_in")).distinct(), "asset_id", "left")
        hit = hit & F.coalesce("_in", F.lit(False))
    if overrides is not None:
        last = overrides.groupBy("asset_id").agg(F.max_by("kind", "seq").alias("_kind"))
        out = out.join(last, "asset_id", "left")
        hit = F.when(F.col("_kind") == "force_exclude", False).when(F.col("_kind") == "force_include", True).otherwise(hit)
    return out.where(hit).drop("_in", "_kind")


def sequence(selected: DataFrame, plan: str, order: list[str]) -> DataFrame:
    """The 1-based place of every asset in its plan, nulls last, without one task for a large plan."""
    keys = selected
    names = []
    for i, o in enumerate(order):
        keys = keys.withColumn(f"_n{i}", F.col(o).isNull())
        names += [f"_n{i}", o]
    chunks = sliced(keys, plan, names)
    out = running_sum(chunks, plan, names, F.lit(1).cast("bigint"), "sequence")
    return out.drop("chunk", *[f"_n{i}" for i in range(len(order))]).withColumn("sequence_text", F.lpad(F.col("sequence").cast("string"), 4, "0"))


def with_collisions(named: DataFrame, plan: str, path: str = "path") -> DataFrame:
    """``collides`` for paths that are equal within their plan but for case."""
    counts = named.groupBy(plan, F.lower(path).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return named.withColumn("_p", F.lower(path)).join(counts, [plan, "_p"]).withColumn("collides", F.col("_n") > 1).drop("_p", "_n")


def safe_name(original: str | Column) -> Column:
    return sanitize_component(original)


def manifest_totals(entries: DataFrame, plan: str, size: str = "byte_size") -> DataFrame:
    """Entries, bytes (overflow is an error), colliding ones and readiness of each plan."""
    return entries.groupBy(plan).agg(F.count(F.lit(1)).alias("n_selected"), F.sum(size).alias("total_bytes"), F.count_if("collides").alias("n_collisions"), (F.count_if("collides") == 0).alias("ready"))


def ordered_checksum(rows: DataFrame, group: str, order: str, columns: list[str], block: int = 1000) -> DataFrame:
    """A digest over each group's ordered rows: digests of blocks of ``block`` places, digested in order.

    ``order`` must be the 1-based place.  Blocks keep a large group out of one task.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in columns])
    blocks = rows.withColumns({"_b": F.floor((F.col(order) - 1) / block), "_t": text}).groupBy(group, "_b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))), lambda s: s["t"]), "\x1e"), 256).alias("_d"))
    return blocks.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda s: s["_d"]), ""), 256).alias("checksum"))


def preferred_copy(copies: DataFrame, asset: str, order: list[Column], available: Column) -> DataFrame:
    """The first available copy of each asset in ``order``; assets without one have no row.

    The rank limit is applied before the shuffle, whatever an asset's share.
    """
    return copies.where(F.coalesce(available, F.lit(False))).withColumn("_r", F.row_number().over(W.partitionBy(asset).orderBy(*order))).where("_r = 1").drop("_r")


# The diagnostics of invalid inputs.
DIAGNOSTICS = ("blank_asset_id", "missing_capture_time", "implausible_capture_time", "invalid_technical_score", "rating_out_of_range", "blank_similar_set", "negative_face_count")


def input_diagnostics(assets: DataFrame, low_ms: int = 946_684_800_000, high_ms: int = 4_102_444_800_000) -> DataFrame:
    """One row for every fault of every asset."""
    t = F.col("captured_at_unix_ms")
    checks = [
        F.coalesce(F.trim("asset_id") == "", F.lit(True)), t.isNull(), (t < low_ms) | (t >= high_ms),
        F.isnan("technical_score") | (F.col("technical_score") < 0) | (F.col("technical_score") > 1), (F.col("rating") < 0) | (F.col("rating") > 5),
        F.exists("similar_set_ids", lambda s: F.trim(s) == ""), F.col("anonymous_face_count") < 0,
    ]
    codes = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in zip(DIAGNOSTICS, checks)]))
    return assets.select("asset_id", F.explode(codes).alias("code"))
