"""Request and manifest checks, status mapping, explanations, maps and tagged values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import safe_relative_path


def validate_request(rows: DataFrame, key: str, thresholds: Iterable[float] = (), weights: Iterable[float] = ()) -> None:
    """Refuses the whole request for a blank or repeated id, a threshold outside [0, 1] or a negative or non-finite weight.

    The id check is one aggregation and stops at the first offender.
    """
    import math

    if any(not 0 <= t <= 1 for t in thresholds):
        raise ValueError("thresholds lie within [0, 1]")
    if any(not math.isfinite(w) or w < 0 for w in weights):
        raise ValueError("weights are finite and not negative")
    if not rows.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).isEmpty():
        raise ValueError(f"blank {key}")
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"repeated {key}")


# The privacy exclusions that a handoff must declare.
EXCLUSIONS = ("private_notes", "preference_model_data", "technical_model_internals", "database_paths")


def manifest_problems(entries: DataFrame, manifest: str, version: int = 1) -> DataFrame:
    """The manifests with an unsafe path, another schema version or a missing exclusion, and which of these.

    ``entries``: the manifest's id, ``schema_version``, ``exclusions`` (array) and
    ``path``.
    """
    missing = F.exists(F.array(*map(F.lit, EXCLUSIONS)), lambda x: ~F.array_contains(F.coalesce("exclusions", F.array().cast("array<string>")), x))
    g = entries.groupBy(manifest).agg(F.bool_or(~safe_relative_path("path")).alias("p"), F.bool_or(~F.coalesce(F.col("schema_version") == version, F.lit(False))).alias("v"), F.bool_or(missing).alias("x"))
    codes = F.array_compact(F.array(F.when(F.col("p"), "unsafe_path"), F.when(F.col("v"), "schema_version"), F.when(F.col("x"), "privacy_exclusion")))
    return g.select(manifest, F.array_join(codes, ",").alias("problems")).where("problems != ''")


# Status of an analysis error.
ERROR_STATUS = {
    "source_unavailable": "needs_original", "unsupported_format": "unsupported", "invalid_image": "corrupt", "corrupt_source": "corrupt", "timeout": "failed", "provider": "failed", "io": "failed", "serialization": "failed",
}


def error_status(code: str | Column) -> Column:
    """The status an error leaves behind; unknown errors are ``failed``, no error is ``ready``."""
    col = F.col(code) if isinstance(code, str) else code
    table = F.create_map(*[F.lit(x) for kv in ERROR_STATUS.items() for x in kv])
    return F.when(col.isNull(), "ready").otherwise(F.coalesce(F.element_at(table, col), F.lit("failed")))


def explain_boundary(category: str | Column, parts: dict[str, tuple[Column, Column]]) -> Column:
    """a sentence from the category and the names of the signals that speak for and against a boundary."""
    col = F.col(category) if isinstance(category, str) else category
    named = lambda side: F.array_join(F.array_compact(F.array(*[F.when(p[side] > 0, F.lit(n.replace("_", " "))) for n, p in parts.items()])), ", ")
    told = lambda text: F.when(text != "", text).otherwise(F.lit("none"))
    return F.format_string("%s boundary; for: %s; against: %s", col, told(named(0)), told(named(1)))


def merged_map(base: str | Column, provider: str, values: dict[str, Column]) -> Column:
    """A raw-metadata map with a provider's values under its name; null values are left out, later ones replace earlier ones."""
    col = F.col(base) if isinstance(base, str) else base
    fresh = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(f"{provider}.{k}"), v.cast("string"))]), lambda _, v: v.isNotNull())
    old = F.map_filter(F.coalesce(col, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(old, fresh)


def tagged(kind: Column, **payload: Column) -> Column:
    """A tagged value: ``kind`` and one nullable payload field for each kind."""
    return F.struct(kind.alias("kind"), *[F.when(kind == k, v).alias(k) for k, v in payload.items()])


# What each format offers.
CAPABILITIES = [("raw", "embedded", "external", True), ("photo", "embedded", "external", True), ("video", "platform", "external", False), ("audio", "header", "none", False), ("sidecar", "none", "none", False)]


def capabilities(spark: SparkSession) -> DataFrame:
    """Metadata, thumbnail and viewer support by media class."""
    return spark.createDataFrame(CAPABILITIES, "media_class string, metadata string, thumbnail string, viewer boolean")
