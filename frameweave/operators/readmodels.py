"""Bounded, filtered, paged read models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import PHOTOS
from .ordered import running_sum, sliced

# Page sizes (default, least, most) of the views.
PAGES = {"browser": (120, 1, 250), "culling": (60, 1, 120), "similar": (60, 1, 120), "timeline": (60, 1, 120), "group": (24, 1, 120), "history": (8, 1, 50)}



def media_type_filter(name: str, column: str = "media_class") -> Column:
    """Rows of a media type; an unknown name means all."""
    groups = {"photos": PHOTOS, "video": ("video",), "audio": ("audio",), "sidecars": ("sidecar",), "unknown": ("unknown",)}
    return F.col(column).isin(*groups[name]) if name in groups else F.lit(True)


def visual_filter(name: str) -> Column:
    """The browser's named filters over the joined evidence row; null evidence fails a filter."""
    c = F.col
    table = {
        "all": F.lit(True), "photos": c("media_class").isin(*PHOTOS), "raw": c("media_class") == "raw", "jpegHeif": c("media_class").isin("jpeg", "heif"),
        "video": c("media_class") == "video", "audio": c("media_class") == "audio", "offline": ~c("available"), "available": c("available"),
        "strongCandidates": c("quality_band") == "strong", "technicalIssues": c("quality_band") == "technical_issue", "probableDuplicates": c("group_kind").isin("exact", "near"),
        "similarGroups": c("group_kind").isNotNull(), "faces": c("face_count") > 0, "possibleClosedEyes": c("closed_eyes"), "blurReview": c("blur_level").isin("high", "moderate", "uncertain"),
    }
    if name not in table:
        raise ValueError(f"unknown filter: {name}")
    return F.coalesce(table[name], F.lit(False))


def culling_filter(name: str, mode: str = "all_photos") -> Column:
    """The culling view's named filters within one of its three modes."""
    c = F.col
    table = {
        "all": F.lit(True), "unreviewed": c("decision").isNull(), "keep": c("decision") == "keep", "reject": c("decision") == "reject", "review": c("decision") == "review", "starred": c("starred"),
        "five_star": c("rating") == 5, "four_plus": c("rating") >= 4, "strong_candidates": c("quality_band") == "strong", "technical_issues": c("quality_band") == "technical_issue",
        "possible_duplicates": c("group_kind").isin("exact", "near"), "similar_groups": c("group_kind").isNotNull(), "faces": c("face_count") > 0, "blur_review": c("blur_level").isin("high", "moderate", "uncertain"),
    }
    modes = {"all_photos": F.lit(True), "similar_sets": c("group_kind").isNotNull(), "ai_review_queue": c("decision").isNull() & c("quality_band").isin("review", "technical_issue")}
    return F.coalesce(table[name], F.lit(False)) & F.coalesce(modes[mode], F.lit(False))


def scope_filter(text: str = "", camera: str = "", lens: str = "", start_ms: int | None = None, end_ms: int | None = None, fields: tuple[str, ...] = ("display_name", "camera_model", "lens_model")) -> Column:
    """Text, camera, lens and time range, trimmed; empty ones are no condition."""
    parts = [F.lit(True)]
    if text.strip():
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(text.strip().lower())), F.lit(False)) for f in fields]))
    for value, col in ((camera, "camera_model"), (lens, "lens_model")):
        if value.strip():
            parts.append(F.col(col) == value.strip())
    if start_ms is not None:
        parts.append(F.col("captured_at_unix_ms") >= start_ms)
    if end_ms is not None:
        parts.append(F.col("captured_at_unix_ms") <= end_ms)
    return reduce(lambda a, b: a & b, parts)


def page(rows: DataFrame, order: list[Column], view: str = "browser", number: int = 0, size: int | None = None) -> DataFrame:
    """One page of a total order and whether more follow.

    A top-k of (number + 1) * size + 1 rows, never a sort of everything.
    """
    default, least, most = PAGES[view]
    n = min(max(size or default, least), most)
    got = rows.orderBy(*order).offset(number * n).limit(n + 1)
    # At most n + 1 rows from here on.
    at = got.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    return at.withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > n).where(F.col("_i") <= n).withColumnRenamed("_i", "place")


def latest_by(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` values; combines before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("r"))).alias("m")).select(*keys, "m.r.*")


def with_evidence(assets: DataFrame, *evidence: tuple[DataFrame, str]) -> DataFrame:
    """Assets with the columns of each evidence table, null where it has no row."""
    return reduce(lambda a, e: a.join(e[0], e[1], "left"), evidence, assets)


def culling_progress(rows: DataFrame, by: str = "project_id") -> DataFrame:
    """The conditional counters of a project's review."""
    d, s = F.col("decision"), F.coalesce(F.col("technical_score") >= 0.76, F.lit(False))
    issue = F.coalesce(F.col("technical_score") < 0.30, F.lit(False))
    n = {
        "n_all": F.lit(True), "n_reviewed": d.isNotNull(), "n_keep": d == "keep", "n_review": d == "review", "n_reject": d == "reject", "n_starred": F.coalesce("starred", F.lit(False)),
        "n_five_star": F.col("rating") == 5, "n_four_plus": F.col("rating") >= 4, "n_strong": s, "n_issue": issue, "n_strong_kept": s & (d == "keep"), "n_issue_kept": issue & (d == "keep"), "n_strong_rejected": s & (d == "reject"),
    }
    return rows.groupBy(by).agg(*[F.count_if(v).alias(k) for k, v in n.items()])


def project_library(assets: DataFrame, by: str = "project_id") -> DataFrame:
    """Counts, distinct devices and last activity of each project."""
    return assets.groupBy(by).agg(F.count(F.lit(1)).alias("n_assets"), F.countDistinct("capture_device_id").alias("n_devices"), F.count_if("starred").alias("n_starred"), F.max("captured_at_unix_ms").alias("last_capture_ms"))


def group_review(rows: DataFrame, group: str) -> DataFrame:
    """Members, reviewed ones and whether the group is completed."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_members"), F.count("decision").alias("n_reviewed"), F.min("asset_id").alias("first_member")).withColumn("completed", F.col("n_members") == F.col("n_reviewed"))


def source_inventory(files: DataFrame, source: str, size: str, kind: str) -> DataFrame:
    """Files, bytes and distinct types of each source."""
    return files.groupBy(source).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"), F.countDistinct(kind).alias("n_types"))


def preflight(inventory: DataFrame, source: str, available: int, reserve: int = 1 << 30) -> DataFrame:
    """Headroom of a destination for each source and what blocks it."""
    room = F.lit(available) - F.col("total_bytes") - F.lit(reserve)
    issues = F.array_compact(F.array(F.when(F.col("n_files") == 0, "nothing_to_copy"), F.when(room < 0, "not_enough_space"), F.when(F.col("total_bytes").isNull(), "unknown_size")))
    return inventory.select(source, room.alias("headroom_bytes"), F.array_join(issues, ",").alias("issues"))


def status_rollup(rows: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """One column a status."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def protection(copies: DataFrame, asset: str, role: str, volume: str, verified: str, failed: str) -> DataFrame:
    """The protection state of each asset from verified roles and distinct volumes."""
    ok = F.coalesce(F.col(verified), F.lit(False))
    s = copies.groupBy(asset).agg(
        F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("n_failed"), F.count_if(ok & (F.col(role) == "master")).alias("n_master"), F.count_if(ok & (F.col(role) == "backup")).alias("n_backup"),
        F.countDistinct(F.when(ok, F.col(volume))).alias("n_volumes"),
    )
    m, b = F.col("n_master") > 0, F.col("n_backup") > 0
    state = F.when(F.col("n_failed") > 0, "needs_attention").when(m & b & (F.col("n_volumes") > 1), "protected").when(m & b, "partially_protected").when(m, "master_copy").otherwise("unprotected")
    return s.withColumn("state", state)


# Priority of capture-time sources.
TIME_PRIORITY = {
    "exif_datetime_original": 100, "exif_datetime_digitized": 90, "exif_create_date": 80, "container_creation_date": 60, "platform_content_creation_date": 50, "wav_origination": 20, "filesystem_modified": 10,
}


def time_priority(source: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIME_PRIORITY.items() for x in kv]), F.col(source)), F.lit(0))


def best_capture_time(candidates: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Of each asset the usable candidate of the highest priority, then the latest observed, then the greatest id."""
    key = F.struct(time_priority("source_tag").alias("p"), F.col("observed_at"), F.col("candidate_id"))
    usable = candidates.where("local_value is not null and trim(local_value) != ''")
    return usable.groupBy(asset).agg(F.max_by(F.struct("candidate_id", "local_value", "tz_value", "source_tag"), key).alias("b")).select(asset, "b.*")


def capture_time_conflicts(candidates: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Assets whose copies carry different embedded capture times; other sources don't count."""
    embedded = F.when(time_priority("source_tag") >= 80, F.col("local_value"))
    return candidates.groupBy(asset).agg(F.countDistinct(embedded).alias("n_values")).where("n_values > 1")


def one_active(rows: DataFrame, by: str, active: Column) -> DataFrame:
    """Keys with more than one active row."""
    return rows.groupBy(by).agg(F.count_if(active).alias("n_active")).where("n_active > 1")


def resequence(rows: DataFrame, group: str, active: str, order: str, key: str) -> DataFrame:
    """Active rows contiguous in display order, stale ones after them by old place and key."""
    chunks = sliced(rows.withColumn("_stale", ~F.col(active)), group, ["_stale", order, key])
    out = running_sum(chunks, group, ["_stale", order, key], F.lit(1).cast("bigint"), "new_ordinal")
    return out.withColumn("new_ordinal", F.col("new_ordinal") - 1).drop("_stale", "chunk")


def relative_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the other members below a value (0 when alone) and the group's size."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    upto = running_sum(sliced(counted, group, [value]), group, [value], F.col("_k"), "_upto")
    size = counted.groupBy(group).agg(F.sum("_k").alias("group_size"))
    rank = F.when(F.col("group_size") > 1, (F.col("_upto") - F.col("_k")) / (F.col("group_size") - 1)).otherwise(0.0)
    places = upto.join(size, group).select(F.col(group).alias("_g"), F.col(value).alias("_v"), rank.alias("relative_rank"), "group_size")
    return rows.join(places, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def stale_evidence(current: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """The work list: current inputs without evidence for exactly this key."""
    return current.join(evidence, key, "left_anti")


def edges_of(edges: DataFrame, kind: str, ids: list[str]) -> DataFrame:
    """The typed edges that start at given entities; one hop."""
    return edges.where((F.col("source_kind") == kind) & F.col("source_id").isin(ids))
