"""Duplicate, similarity and burst groups.

Bucketed candidate generation keeps the reference semantics: a bucket with more
members than its cap is skipped as a whole (the complete search without a cap is
the grid clustering of the training-data operators).  The cap also bounds every
self-join here: at most cap*(cap-1)/2 pairs a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import bucket, digest
from ..session import cut, merge_join
from .components import connected_components
from .similarity import color_similarity, cosine_unit, hamming, square, visual_similarity

KIND_PRIORITY = {"exact": 0, "near": 1, "burst": 2, "similar": 3}


@dataclass(frozen=True)
class GroupingConfig:
    bucket_cap: int = 96
    exhaustive_rows: int = 256
    near_distance: int = 10
    near_similarity: float = 0.86
    similar_distance: int = 18
    similar_similarity: float = 0.78
    similar_seconds: int = 120
    time_bucket_s: int = 12
    burst_bucket_s: int = 10
    burst_least: int = 3
    burst_similarity: float = 0.78
    burst_span_s: int = 12


def _slim(x: DataFrame) -> DataFrame:
    return x.select("project_id", "asset_id", "perceptual_hash", "color_signature", "embedding", "camera_model", "captured_at_s")


def bucket_pairs(assets: DataFrame, keys: Column, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """``project_id, a, b`` (a < b) of assets that share a bucket of at most ``bucket_cap`` members."""
    rows = assets.select("project_id", "asset_id", F.explode(F.array_distinct(keys)).alias("bucket")).distinct()
    sizes = rows.groupBy("project_id", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, config.bucket_cap))
    kept = rows.join(sizes.drop("n"), ["project_id", "bucket"])
    other = kept.select("project_id", "bucket", F.col("asset_id").alias("b"))
    return kept.withColumnRenamed("asset_id", "a").join(other, ["project_id", "bucket"]).where("a < b").select("project_id", "a", "b").distinct()


def time_pairs(assets: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """Pairs of one camera within one tumbling time bucket, under the same cap."""
    key = F.concat_ws("\x00", "camera_model", bucket("captured_at_s", config.time_bucket_s).cast("string"))
    timed = assets.where("captured_at_s is not null and camera_model is not null and camera_model != ''")
    return bucket_pairs(timed, F.array(key), config)


def exhaustive_pairs(assets: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """All pairs of a project with at most ``exhaustive_rows`` assets; larger projects have none."""
    rows = assets.select("project_id", "asset_id").distinct()
    small = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= config.exhaustive_rows)
    kept = rows.join(small.drop("n"), "project_id")
    return kept.withColumnRenamed("asset_id", "a").join(kept.withColumnRenamed("asset_id", "b"), "project_id").where("a < b")


def candidate_pairs(assets: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """The union of bucket, time and small-project candidates, each pair once."""
    by_hash = bucket_pairs(assets.where("bucket_keys is not null"), F.col("bucket_keys"), config)
    return by_hash.unionByName(time_pairs(assets, config)).unionByName(exhaustive_pairs(assets, config)).distinct()


def score_pairs(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """H5: distance and similarities of ``project_id, a, b``, with the assets' cameras and times.

    Invalid hashes count as distance 64; pairs of assets not in ``assets`` are dropped.
    """
    side = lambda p: _slim(assets).select("project_id", F.col("asset_id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("perceptual_hash", "color_signature", "embedding", "camera_model", "captured_at_s")], square("embedding").alias(f"{p}_square"))
    both = pairs.select("project_id", "a", "b").join(side("a"), ["project_id", "a"]).join(side("b"), ["project_id", "b"])
    both = both.withColumns({"perceptual_distance": hamming("a_perceptual_hash", "b_perceptual_hash"), "color_similarity": color_similarity("a_color_signature", "b_color_signature"), "embedding_similarity": cosine_unit("a_embedding", "b_embedding", F.col("a_square"), F.col("b_square"))})
    both = both.withColumn("visual_similarity", visual_similarity(F.col("perceptual_distance"), F.col("color_similarity"), F.col("embedding_similarity")))
    return both.select("project_id", "a", "b", "perceptual_distance", "visual_similarity", "color_similarity", "embedding_similarity", "a_camera_model", "b_camera_model", "a_captured_at_s", "b_captured_at_s")


def gate_pairs(scored: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """Pairs near enough to group; ``near`` needs no camera or time, the wider gate one of them."""
    near = (F.col("perceptual_distance") <= config.near_distance) & (F.col("visual_similarity") >= config.near_similarity)
    camera = F.coalesce((F.col("a_camera_model") == F.col("b_camera_model")) & (F.col("a_camera_model") != ""), F.lit(False))
    close = F.coalesce(F.abs(F.col("a_captured_at_s") - F.col("b_captured_at_s")) <= config.similar_seconds, F.lit(False))
    wide = (F.col("perceptual_distance") <= config.similar_distance) & (F.col("visual_similarity") >= config.similar_similarity) & (camera | close)
    return scored.where(near | wide).withColumn("near", near)


def group_id(project: Column, kind: Column, members: Column) -> Column:
    """A4: the digest of project, kind and sorted members."""
    return digest(project, kind, F.array_join(members, "\x00"))


def representative(asset: str = "asset_id", quality: str = "quality") -> Column:
    """A4: the member of the highest quality, null as the lowest, ties to the smallest id."""
    return F.min_by(F.col(asset), F.struct((-F.coalesce(quality, F.lit(float("-inf")))).alias("q"), F.col(asset).alias("i")))


def exact_groups(assets: DataFrame, hash_column: str = "verified_content_hash", project: str = "project_id", asset: str = "asset_id") -> DataFrame:
    """A1: ``project_id, hash, n_members, first_member`` of every non-empty hash of two or more assets in a project."""
    rows = assets.where(F.col(hash_column).isNotNull() & (F.col(hash_column) != "")).select(F.col(project).alias("project_id"), F.col(hash_column).alias("hash"), F.col(asset).alias("asset_id")).distinct()
    return rows.groupBy("project_id", "hash").agg(F.count(F.lit(1)).alias("n_members"), F.min("asset_id").alias("first_member")).where("n_members > 1")


def visual_groups(accepted: DataFrame, assets: DataFrame, config: GroupingConfig = GroupingConfig()) -> tuple[DataFrame, DataFrame]:
    """A3, A4, A5: groups from the accepted pairs, and their members.

    A group's kind is decided by the averages over its accepted pairs.  ``span_s``
    is null unless every member has a time.
    """
    # An asset of two projects is a vertex of each: groups never reach across projects.
    at = lambda x: F.concat_ws("\x00", "project_id", x)
    edges = cut(accepted.withColumns({"va": at("a"), "vb": at("b")}))
    label = cut(connected_components(edges, "va", "vb"))
    of_edge = merge_join(edges, label.withColumnRenamed("node", "va"), "va").groupBy("project_id", "label").agg(F.avg("perceptual_distance").alias("avg_distance"), F.avg("visual_similarity").alias("avg_similarity"), F.count(F.lit(1)).alias("n_pairs"))
    info = assets.where("project_id is not null").groupBy(at("asset_id").alias("node")).agg(F.max("quality").alias("quality"), F.max("captured_at_s").alias("captured_at_s"))
    asset = lambda x: F.substring_index(x, "\x00", -1)
    members = merge_join(label, info, "node", "left").withColumn("asset_id", asset("node"))
    span = F.when(F.count("captured_at_s") == F.count(F.lit(1)), F.max("captured_at_s") - F.min("captured_at_s"))
    shape = members.groupBy("label").agg(F.count(F.lit(1)).alias("n_members"), representative().alias("representative"), span.alias("span_s"))
    near = (F.col("avg_distance") <= config.near_distance) & (F.col("avg_similarity") >= config.near_similarity)
    groups = merge_join(of_edge, shape, "label").withColumns({"kind": F.when(near, "near").otherwise("similar"), "first_member": asset("label")}).drop("label")
    return groups, members.select(F.substring_index("label", "\x00", 1).alias("project_id"), asset("label").alias("first_member"), "asset_id")


def burst_groups(assets: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """A2: bursts of one camera within a tumbling bucket: 3 to 96 frames, similar on average, within the span."""
    keyed = assets.where("captured_at_s is not null and camera_model is not null and camera_model != ''").withColumn("bucket", bucket("captured_at_s", config.burst_bucket_s))
    by = ["project_id", "camera_model", "bucket"]
    shape = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_members"), F.min("asset_id").alias("first_member"), (F.max("captured_at_s") - F.min("captured_at_s")).alias("span_s"), representative().alias("representative"))
    kept = shape.where(F.col("n_members").between(config.burst_least, config.bucket_cap) & (F.col("span_s") <= config.burst_span_s))
    inside = keyed.join(kept.select(*by), by).select(*by, "asset_id")
    pairs = inside.withColumnRenamed("asset_id", "a").join(inside.withColumnRenamed("asset_id", "b"), by).where("a < b")
    scored = score_pairs(pairs, assets).select("project_id", "a", "b", "visual_similarity")
    mean = pairs.join(scored, ["project_id", "a", "b"]).groupBy(*by).agg(F.avg("visual_similarity").alias("avg_similarity"))
    return kept.join(mean, by).where(F.col("avg_similarity") >= config.burst_similarity)


def primary_groups(members: DataFrame) -> DataFrame:
    """Of ``asset_id, kind, group_key`` the group with the best kind, then the smallest key, per asset."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv]), F.col("kind"))
    return members.withColumn("_r", F.row_number().over(W.partitionBy("asset_id").orderBy(rank.asc_nulls_last(), "group_key"))).where("_r = 1").drop("_r")


def pair_diagnostics(scored: DataFrame, accepted: DataFrame) -> DataFrame:
    """Extent of distances and similarities, candidates and acceptances of each project."""
    a = accepted.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_accepted"), F.count_if("near").alias("n_near"))
    s = scored.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("perceptual_distance").alias("least_distance"), F.max("perceptual_distance").alias("most_distance"), F.round(F.avg("visual_similarity"), 6).alias("avg_similarity"))
    return s.join(a, "project_id", "left").na.fill(0, ["n_accepted", "n_near"])


def stale_scores(stored: DataFrame, assets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """T6 on stored pair scores: each pair once (latest), recomputed from the fingerprints, with ``stale`` where they disagree."""
    a, b = F.least("left_asset_id", "right_asset_id"), F.greatest("left_asset_id", "right_asset_id")
    keyed = stored.where("left_asset_id != right_asset_id").select("project_id", a.alias("a"), b.alias("b"), "computed_at", F.col("perceptual_distance").alias("stored_distance"), F.col("visual_similarity").alias("stored_similarity"))
    last = keyed.groupBy("project_id", "a", "b").agg(F.max(F.struct("computed_at", "stored_distance", "stored_similarity")).alias("s")).select("project_id", "a", "b", "s.*")
    fresh = score_pairs(last, _slim(assets).dropDuplicates(["project_id", "asset_id"])).select("project_id", "a", "b", "perceptual_distance", "visual_similarity")
    same = (F.col("stored_distance") == F.col("perceptual_distance")) & (F.abs(F.col("stored_similarity") - F.col("visual_similarity")) <= tolerance)
    return last.join(fresh, ["project_id", "a", "b"]).withColumn("stale", ~F.coalesce(same, F.lit(False)))
