"""Queries of the reference operators over whole tables, and their SQL.

Each entry is ``name -> (query, SQL or None)``; entries without SQL are iterative,
streaming or user-code operators that are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import groups as G
from ..operators import matching, readmodels as R, selection
from ..operators.components import connected_components
from ..operators.similarity import hamming
from ..session import cut, load

# shared inputs -------------------------------------------------------------


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """The counting row of each asset."""
    return R.latest_by(load(spark, sf, "timeline_asset").where("asset_id is not null"), "asset_id", ["ingested_at"])


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint rows, each once."""
    return load(spark, sf, "fingerprint_evidence").distinct()


# Rows of one asset ingested at the same time are settled by the greatest values in column order.
_TIES = "project_id capture_device_id captured_at_unix_ms camera_model lens_model orientation anonymous_face_count similar_set_ids filename_sequence technical_score decision rating starred".split()
ASSETS = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ('ingested_at', *_TIES))}) AS rn
    FROM timeline_asset WHERE asset_id IS NOT NULL) WHERE rn = 1)"""
EVIDENCE = "(SELECT DISTINCT * FROM fingerprint_evidence)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# selection and copies --------------------------------------------------------

_MANIFEST = f"""
    m AS (SELECT a.project_id, a.asset_id, a.captured_at_unix_ms AS t, a.rating, a.decision, coalesce(a.camera_model, '') AS camera
          FROM {ASSETS} a WHERE a.decision = 'keep' AND a.rating >= 3),
    named AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY t IS NULL, t, asset_id) AS sequence,
          CASE WHEN trim(camera) = '' THEN 'Untitled' ELSE trim(camera) END AS name FROM m)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    kept = selection.select_assets(assets(spark, sf), selection.Rules(decisions=("keep",), least_rating=3))
    placed = selection.sequence(kept.select("project_id", "asset_id", "captured_at_unix_ms", "rating", "camera_model"), "project_id", ["captured_at_unix_ms", "asset_id"])
    return selection.with_collisions(placed.withColumn("path", X.sanitize_component(F.coalesce("camera_model", F.lit("")))), "project_id")


@query("manifest_select", f"WITH {_MANIFEST} SELECT project_id, asset_id, sequence, lpad(sequence::VARCHAR, 4, '0') AS sequence_text, name AS path, count(*) OVER (PARTITION BY project_id, lower(name)) > 1 AS collides FROM named")
def manifest_select(spark, sf):
    """Kept assets rated 3 or more, numbered within their project; colliding names flagged."""
    return _manifest(spark, sf).select("project_id", "asset_id", "sequence", "sequence_text", "path", "collides")


@query("manifest_totals", f"WITH {_MANIFEST}, c AS (SELECT *, count(*) OVER (PARTITION BY project_id, lower(name)) > 1 AS collides FROM named) SELECT project_id, count(*) AS n_selected, sum(rating)::BIGINT AS total_bytes, count(*) FILTER (collides) AS n_collisions, count(*) FILTER (collides) = 0 AS ready FROM c GROUP BY project_id")
def manifest_totals(spark, sf):
    """Totals of each project's manifest (ratings stand in for sizes)."""
    return selection.manifest_totals(_manifest(spark, sf).withColumn("byte_size", F.col("rating").cast("bigint")), "project_id")


@query("manifest_overrides", f"""
    WITH o AS (SELECT asset_id, max_by(kind, seq) AS kind FROM (SELECT chosen_asset_id AS asset_id, CASE WHEN training_eligible THEN 'force_include' ELSE 'force_exclude' END AS kind,
        (occurred_at_unix_ms, preference_id) AS seq FROM pairwise_preference WHERE chosen_asset_id IS NOT NULL) GROUP BY asset_id)
    SELECT a.project_id, count(*) AS n_selected FROM {ASSETS} a LEFT JOIN o USING (asset_id)
    WHERE CASE WHEN o.kind = 'force_exclude' THEN false WHEN o.kind = 'force_include' THEN true
        ELSE coalesce(a.decision = 'keep' AND a.asset_id IN (SELECT asset_id FROM fingerprint_evidence), false) END GROUP BY a.project_id""")
def manifest_overrides(spark, sf):
    """Rules within a collection (assets with evidence), with the last override of each asset."""
    over = load(spark, sf, "pairwise_preference").where("chosen_asset_id is not null").select(F.col("chosen_asset_id").alias("asset_id"), F.when(F.coalesce("training_eligible", F.lit(False)), "force_include").otherwise("force_exclude").alias("kind"), F.struct("occurred_at_unix_ms", "preference_id").alias("seq"))
    got = selection.select_assets(assets(spark, sf), selection.Rules(decisions=("keep",)), load(spark, sf, "fingerprint_evidence"), over)
    return got.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_selected"))


@query("preferred_source", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A') DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r
        FROM lineitem WHERE l_linestatus = 'F') WHERE r = 1""")
def preferred_source(spark, sf):
    """The preferred available line of each order; the rank limit runs before the shuffle."""
    order = [(F.col("l_returnflag") == "A").desc(), F.col("l_shipdate").desc(), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    return selection.preferred_copy(load(spark, sf, "lineitem"), "l_orderkey", order, F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "l_partkey")


@query("input_diagnostics", f"""
    SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(trim(asset_id) = '', true) THEN 'blank_asset_id' END, CASE WHEN captured_at_unix_ms IS NULL THEN 'missing_capture_time' END,
        CASE WHEN captured_at_unix_ms < 946684800000 OR captured_at_unix_ms >= 4102444800000 THEN 'implausible_capture_time' END,
        CASE WHEN isnan(technical_score) OR technical_score < 0 OR technical_score > 1 THEN 'invalid_technical_score' END, CASE WHEN rating < 0 OR rating > 5 THEN 'rating_out_of_range' END,
        CASE WHEN len(list_filter(similar_set_ids, lambda s: trim(s) = '')) > 0 THEN 'blank_similar_set' END, CASE WHEN anonymous_face_count < 0 THEN 'negative_face_count' END], lambda c: c IS NOT NULL)) AS code FROM timeline_asset) GROUP BY code""")
def input_diagnostics(spark, sf):
    """Faults of the delivered rows by code."""
    return selection.input_diagnostics(load(spark, sf, "timeline_asset")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# read models -----------------------------------------------------------------


@query("latest_event_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, sf):
    """The last event of each user."""
    return R.latest_by(load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("asset_evidence_left", f"SELECT a.asset_id, a.project_id, a.decision, e.quality, e.perceptual_hash FROM {ASSETS} a LEFT JOIN (SELECT DISTINCT asset_id, quality, perceptual_hash FROM fingerprint_evidence) e USING (asset_id)")
def asset_evidence_left(spark, sf):
    """Assets with their evidence, null where absent."""
    return R.with_evidence(assets(spark, sf).select("asset_id", "project_id", "decision"), (evidence(spark, sf).select("asset_id", "quality", "perceptual_hash").distinct(), "asset_id"))


@query("unreviewed_anti", f"SELECT asset_id FROM {ASSETS} WHERE asset_id NOT IN (SELECT chosen_asset_id FROM pairwise_preference WHERE chosen_asset_id IS NOT NULL)")
def unreviewed_anti(spark, sf):
    """Assets that were never chosen."""
    return assets(spark, sf).select("asset_id").join(load(spark, sf, "pairwise_preference").select(F.col("chosen_asset_id").alias("asset_id")), "asset_id", "left_anti")


@query("resume_semi", "SELECT DISTINCT file_instance_id FROM media_metadata WHERE file_instance_id IN (SELECT file_instance_id FROM capture_time_candidate)")
def resume_semi(spark, sf):
    """Copies that already have candidates."""
    return load(spark, sf, "media_metadata").select("file_instance_id").distinct().join(load(spark, sf, "capture_time_candidate"), "file_instance_id", "left_semi")


@query("reindex_merge", """
    WITH o AS (SELECT doc_id, n_chars, lang FROM documents WHERE written_at < TIMESTAMPTZ '2024-01-01'), n AS (SELECT doc_id, n_chars, upper(lang) AS lang FROM documents WHERE received_at >= TIMESTAMPTZ '2023-01-01')
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'unavailable' WHEN o.n_chars IS NOT DISTINCT FROM n.n_chars AND o.lang IS NOT DISTINCT FROM n.lang THEN 'reused' ELSE 'changed' END AS status
        FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id) GROUP BY status""")
def reindex_merge(spark, sf):
    """An index of documents written before 2024 against a scan of those received from 2023 on."""
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "written_at", "received_at")
    old, new = d.where("written_at < timestamp'2024-01-01 00:00:00 UTC'"), d.where("received_at >= timestamp'2023-01-01 00:00:00 UTC'").withColumn("lang", F.upper("lang"))
    return matching.merge_index(old, new, "doc_id", ["n_chars", "lang"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("project_library", f"SELECT project_id, count(*) AS n_assets, count(DISTINCT capture_device_id) AS n_devices, count(*) FILTER (starred) AS n_starred, max(captured_at_unix_ms) AS last_capture_ms FROM {ASSETS} GROUP BY project_id")
def project_library(spark, sf):
    """The project cards."""
    return R.project_library(assets(spark, sf))


@query("culling_progress", f"""
    SELECT project_id, count(*) AS n_all, count(decision) AS n_reviewed, count(*) FILTER (decision = 'keep') AS n_keep, count(*) FILTER (decision = 'review') AS n_review, count(*) FILTER (decision = 'reject') AS n_reject,
        count(*) FILTER (starred) AS n_starred, count(*) FILTER (rating = 5) AS n_five_star, count(*) FILTER (rating >= 4) AS n_four_plus, count(*) FILTER (technical_score >= 0.76::DOUBLE) AS n_strong, count(*) FILTER (technical_score < 0.30::DOUBLE) AS n_issue,
        count(*) FILTER (technical_score >= 0.76::DOUBLE AND decision = 'keep') AS n_strong_kept, count(*) FILTER (technical_score < 0.30::DOUBLE AND decision = 'keep') AS n_issue_kept, count(*) FILTER (technical_score >= 0.76::DOUBLE AND decision = 'reject') AS n_strong_rejected
    FROM (SELECT * REPLACE (technical_score::DOUBLE AS technical_score) FROM {ASSETS}) GROUP BY project_id""")
def culling_progress(spark, sf):
    """Thirteen counters of each project."""
    return R.culling_progress(assets(spark, sf).withColumn("technical_score", F.col("technical_score").cast("double")))


@query("group_review", f"WITH m AS (SELECT asset_id, decision, unnest(similar_set_ids) AS set_id FROM {ASSETS}) SELECT set_id, count(*) AS n_members, count(decision) AS n_reviewed, min(asset_id) AS first_member, count(*) = count(decision) AS completed FROM m GROUP BY set_id")
def group_review(spark, sf):
    """Review state of each similar set."""
    return R.group_review(assets(spark, sf).select("asset_id", "decision", F.explode("similar_set_ids").alias("set_id")), "set_id")


@query("status_rollup", "SELECT project_id, " + ", ".join(f"count(*) FILTER (artifact_status = '{s}') AS n_{s}" for s in ("ready", "pending", "failed", "unsupported", "corrupt", "stale")) + " FROM (SELECT DISTINCT * FROM media_metadata) GROUP BY project_id")
def status_rollup(spark, sf):
    """Terminal states of each project's copies."""
    return R.status_rollup(load(spark, sf, "media_metadata").distinct(), "project_id", "artifact_status", ["ready", "pending", "failed", "unsupported", "corrupt", "stale"])


@query("session_summary", f"SELECT capture_device_id, count(*) AS n_items, count(DISTINCT project_id) AS n_projects, count(*) FILTER (decision = 'keep') AS n_approved, count(*) FILTER (decision = 'review') AS n_needs_revision, count(*) FILTER (decision IS NULL) AS n_missing FROM {ASSETS} GROUP BY capture_device_id")
def session_summary(spark, sf):
    """Work items of each device by state."""
    d = F.col("decision")
    return assets(spark, sf).groupBy("capture_device_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("project_id").alias("n_projects"), F.count_if(d == "keep").alias("n_approved"), F.count_if(d == "review").alias("n_needs_revision"), F.count_if(d.isNull()).alias("n_missing"))


@query("guardian_state", """
    WITH s AS (SELECT asset_id, count(*) FILTER (available AND NOT coalesce(verified, false) AND content_checksum IS NULL) AS n_failed, count(*) FILTER (verified AND relative_path ILIKE '%.arw') AS n_master,
        count(*) FILTER (verified AND NOT relative_path ILIKE '%.arw') AS n_backup, count(DISTINCT CASE WHEN verified THEN source_root_id END) AS n_volumes FROM delivery_source GROUP BY asset_id)
    SELECT state, count(*) AS n FROM (SELECT CASE WHEN n_failed > 0 THEN 'needs_attention' WHEN n_master > 0 AND n_backup > 0 AND n_volumes > 1 THEN 'protected' WHEN n_master > 0 AND n_backup > 0 THEN 'partially_protected'
        WHEN n_master > 0 THEN 'master_copy' ELSE 'unprotected' END AS state FROM s) GROUP BY state""")
def guardian_state(spark, sf):
    """Protection states; raw files stand for masters."""
    d = load(spark, sf, "delivery_source").withColumns({"role": F.when(F.lower("relative_path").endswith(".arw"), "master").when(F.col("relative_path").isNotNull(), "backup"), "bad": F.col("available") & ~F.coalesce("verified", F.lit(False)) & F.col("content_checksum").isNull()})
    return R.protection(d, "asset_id", "role", "source_root_id", "verified", "bad").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("preflight_inventory", "WITH s AS (SELECT source_root_id, count(*) AS n, sum(byte_size) AS b, count(DISTINCT lower(regexp_extract(relative_path, '^.+\\.([^.]*)$', 1))) AS k FROM delivery_source GROUP BY source_root_id) SELECT source_root_id, n AS n_files, b::BIGINT AS total_bytes, k AS n_types FROM s")
def preflight_inventory(spark, sf):
    """Files, bytes and types of each source root."""
    d = load(spark, sf, "delivery_source").withColumn("kind", F.lower(F.regexp_extract("relative_path", r"^.+\.([^.]*)$", 1)))
    return R.source_inventory(d, "source_root_id", "byte_size", "kind")


@query("browser_page", "SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place, true AS has_more FROM (SELECT * FROM part WHERE p_name ILIKE '%a%' ORDER BY p_size DESC, p_partkey LIMIT 120 OFFSET 120)")
def browser_page(spark, sf):
    """The second page of a filtered, totally ordered view (a page is the feature)."""
    rows = load(spark, sf, "part").where(R.scope_filter(text="a", fields=("p_name",)))
    return R.page(rows, [F.desc("p_size"), F.col("p_partkey")], "browser", 1).select("p_partkey", "p_name", "p_size", F.col("place").cast("bigint").alias("place"), "has_more")


@query("culling_queue", f"SELECT asset_id, project_id FROM {ASSETS} WHERE decision IS NULL AND technical_score::DOUBLE >= 0.30::DOUBLE AND technical_score::DOUBLE < 0.54::DOUBLE")
def culling_queue(spark, sf):
    """Unreviewed assets of the review queue."""
    s = F.col("technical_score").cast("double")
    band = F.when(s >= 0.76, "strong").when(s >= 0.54, "good").when(s >= 0.30, "review").when(s < 0.30, "technical_issue")
    rows = assets(spark, sf).withColumns({"quality_band": F.when(band == "technical_issue", F.lit(None)).otherwise(band), "group_kind": F.lit(None).cast("string"), "face_count": F.col("anonymous_face_count"), "blur_level": F.lit(None).cast("string")})
    return rows.where(R.culling_filter("unreviewed", "ai_review_queue")).select("asset_id", "project_id")


@query("capture_priority", """
    WITH c AS (SELECT *, CASE source_tag WHEN 'exif_datetime_original' THEN 100 WHEN 'exif_datetime_digitized' THEN 90 WHEN 'exif_create_date' THEN 80 WHEN 'container_creation_date' THEN 60 WHEN 'platform_content_creation_date' THEN 50
        WHEN 'wav_origination' THEN 20 WHEN 'filesystem_modified' THEN 10 ELSE 0 END AS p FROM capture_time_candidate WHERE trim(local_value) <> '')
    SELECT asset_id, candidate_id, local_value, source_tag FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY p DESC, observed_at DESC NULLS LAST, candidate_id DESC) AS r FROM c) WHERE r = 1 AND asset_id IS NOT NULL""")
def capture_priority(spark, sf):
    """The capture time that counts for each asset."""
    return R.best_capture_time(load(spark, sf, "capture_time_candidate").where("asset_id is not null")).select("asset_id", "candidate_id", "local_value", "source_tag")


@query("capture_conflicts", """SELECT asset_id, count(DISTINCT CASE WHEN source_tag IN ('exif_datetime_original', 'exif_datetime_digitized', 'exif_create_date') THEN local_value END) AS n_values FROM capture_time_candidate GROUP BY asset_id
    HAVING count(DISTINCT CASE WHEN source_tag IN ('exif_datetime_original', 'exif_datetime_digitized', 'exif_create_date') THEN local_value END) > 1""")
def capture_conflicts(spark, sf):
    """Assets whose copies disagree on their embedded time."""
    return R.capture_time_conflicts(load(spark, sf, "capture_time_candidate"))


@query("one_active", "SELECT project_id, count(*) FILTER (artifact_status = 'pending') AS n_active FROM media_metadata GROUP BY project_id HAVING count(*) FILTER (artifact_status = 'pending') > 1")
def one_active(spark, sf):
    """Projects with more than one pending copy."""
    return R.one_active(load(spark, sf, "media_metadata"), "project_id", F.col("artifact_status") == "pending")


@query("stale_work_list", "SELECT DISTINCT asset_id FROM semantic_vector WHERE (asset_id) NOT IN (SELECT asset_id FROM fingerprint_evidence WHERE asset_id IS NOT NULL)")
def stale_work_list(spark, sf):
    """Assets with vectors but without fingerprints."""
    return R.stale_evidence(load(spark, sf, "semantic_vector").select("asset_id").distinct(), load(spark, sf, "fingerprint_evidence").select("asset_id"), ["asset_id"])


@query("resequence", f"SELECT asset_id, (row_number() OVER (PARTITION BY set_id ORDER BY (decision IS DISTINCT FROM 'reject') DESC, t, asset_id) - 1)::BIGINT AS new_ordinal, set_id FROM (SELECT asset_id, decision, coalesce(captured_at_unix_ms, 0) AS t, unnest(similar_set_ids) AS set_id FROM {ASSETS})")
def resequence(spark, sf):
    """Kept members of each similar set first, in order of time."""
    rows = assets(spark, sf).select("asset_id", F.coalesce(F.col("decision") != "reject", F.lit(True)).alias("active"), F.coalesce("captured_at_unix_ms", F.lit(0)).alias("t"), F.explode("similar_set_ids").alias("set_id"))
    return R.resequence(rows, "set_id", "active", "t", "asset_id").select("set_id", "asset_id", F.col("new_ordinal").cast("bigint").alias("new_ordinal"))


@query("relative_rank", f"SELECT set_id, asset_id, round(percent_rank() OVER (PARTITION BY set_id ORDER BY s), 6) AS relative_rank, count(*) OVER (PARTITION BY set_id) AS group_size FROM (SELECT asset_id, coalesce(technical_score::DOUBLE, 0) AS s, unnest(similar_set_ids) AS set_id FROM {ASSETS})")
def relative_rank(spark, sf):
    """Technical rank within each similar set."""
    rows = assets(spark, sf).select("asset_id", F.coalesce(F.col("technical_score").cast("double"), F.lit(0.0)).alias("s"), F.explode("similar_set_ids").alias("set_id"))
    return R.relative_rank(rows, "set_id", "s").select("set_id", "asset_id", F.round("relative_rank", 6).alias("relative_rank"), "group_size")


@query("edges_one_hop", "WITH top AS (SELECT left_asset_id FROM similarity_evidence WHERE left_asset_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, left_asset_id LIMIT 1) SELECT DISTINCT right_asset_id AS target_id, project_id FROM similarity_evidence WHERE left_asset_id IN (SELECT left_asset_id FROM top)")
def edges_one_hop(spark, sf):
    """The edges of the asset with the most stored pairs (one entity is the feature)."""
    e = load(spark, sf, "similarity_evidence").select(F.lit("asset").alias("source_kind"), F.col("left_asset_id").alias("source_id"), F.col("right_asset_id").alias("target_id"), "project_id")
    top = e.where("source_id is not null").groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(1).collect()
    return R.edges_of(e, "asset", [r["source_id"] for r in top]).select("target_id", "project_id").distinct()


# names, dates, JSON ----------------------------------------------------------


@query("classify_extension", """
    SELECT media_class, count(*) AS n FROM (SELECT CASE WHEN e IN ('arw', 'cr2', 'cr3', 'dng', 'nef', 'orf', 'raf', 'rw2', 'pef', 'srw', '3fr') THEN 'raw' WHEN e IN ('jpg', 'jpeg') THEN 'jpeg' WHEN e IN ('heic', 'heif') THEN 'heif'
        WHEN e = 'png' THEN 'png' WHEN e IN ('tif', 'tiff') THEN 'tiff' WHEN e IN ('mov', 'mp4', 'm4v', 'avi', 'mxf') THEN 'video' WHEN e IN ('wav', 'mp3', 'm4a', 'aac', 'aif', 'aiff') THEN 'audio' WHEN e IN ('xmp', 'srt', 'xml', 'json') THEN 'sidecar' ELSE 'unknown' END AS media_class
        FROM (SELECT lower(regexp_extract(split_part(relative_path, '/', -1), '^.+\\.([^.]*)$', 1)) AS e FROM delivery_source)) GROUP BY media_class""")
def classify_extension(spark, sf):
    """Copies by media class."""
    return load(spark, sf, "delivery_source").select(X.media_class("relative_path").alias("media_class")).groupBy("media_class").agg(F.count(F.lit(1)).alias("n"))


@query("sanitize_names", r"""
    SELECT p_partkey, left(CASE WHEN t = '' THEN 'Untitled' WHEN regexp_matches(upper(split_part(t, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || t ELSE t END, 120) AS component,
           left(regexp_replace(p_type, '[^A-Za-z0-9_-]', '', 'g'), 120) AS cache_key, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS ingest_name FROM (
        SELECT *, regexp_replace(trim(trim(trim(regexp_replace(p_name || ' /' || p_brand, '[\x00-\x1f\x7f/\\:*?"<>|]', '_', 'g')), '.')), '_{2,}', '_', 'g') AS t FROM part)""")
def sanitize_names(spark, sf):
    """three kinds of safe names."""
    return load(spark, sf, "part").select("p_partkey", X.sanitize_component(F.concat("p_name", F.lit(" /"), "p_brand")).alias("component"), X.cache_component("p_type").alias("cache_key"), X.ingest_component("p_type").alias("ingest_name"))


@query("render_names", f"SELECT asset_id, coalesce(project_id, '') || '_' || coalesce(replace(substr(strftime(make_timestamp(captured_at_unix_ms * 1000), '%Y-%m-%d'), 1, 10), '-', ''), 'UnknownDate') || '_' || coalesce(camera_model, 'camera') AS name FROM {ASSETS}")
def render_names(spark, sf):
    """Names from a template of project, capture date and camera."""
    day = F.date_format(F.timestamp_millis("captured_at_unix_ms"), "yyyy-MM-dd")
    t = X.render_template("{project}_{capture_date}_{camera}", {"project": F.coalesce("project_id", F.lit("")), "capture_date": X.date_token(day), "camera": F.coalesce("camera_model", F.lit("camera"))})
    return assets(spark, sf).select("asset_id", t.alias("name"))


@query("path_safety", r"SELECT coalesce(NOT (p = '' OR contains(p, chr(0)) OR starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|/)\.{0,2}(/|$)')), false) AS safe, count(*) AS n FROM (SELECT replace(relative_path, '\', '/') AS p FROM delivery_source) GROUP BY 1")
def path_safety(spark, sf):
    """Relative paths by safety."""
    return load(spark, sf, "delivery_source").select(X.safe_relative_path("relative_path").alias("safe")).groupBy("safe").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_space", r"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ +| +$', '', 'g'))) AS digest FROM documents")
def normalize_space(spark, sf):
    """digests of the normalised texts."""
    return load(spark, sf, "documents").select("doc_id", F.md5(X.normalize_space("text")).alias("digest"))


@query("csv_and_html", r"""
    SELECT ref_id, CASE WHEN regexp_matches(g, '[",\r\n]') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell, replace(replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html
    FROM (SELECT ref_id, n, regexp_replace(n, '^([=+\-@])', '''\1') AS g FROM (SELECT ref_id, '=' || canonical_name || ', "' || maker || '" & <x>''' AS n FROM gear_ref))""")
def csv_and_html(spark, sf):
    """F8: escaped cells."""
    n = F.concat(F.lit("="), "canonical_name", F.lit(', "'), "maker", F.lit("\" & <x>'"))
    return load(spark, sf, "gear_ref").select("ref_id", X.csv_cell(n).alias("cell"), X.html_text(n).alias("html"))


@query("camera_dates", r"""
    SELECT metadata_id, epoch_us(try_cast(regexp_replace(captured_at_raw, '^\s*(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})(?:\s*\.(\d{1,6})\d{0,3})?.*$', CASE WHEN regexp_matches(captured_at_raw, '\.\d') THEN '\1-\2-\3 \4.\5' ELSE '\1-\2-\3 \4' END) AS TIMESTAMP)) AS wall_us,
        CASE WHEN regexp_matches(captured_at_raw, '[+-]\d{2}:\d{2}\s*$') THEN regexp_extract(captured_at_raw, '([+-]\d{2}:\d{2})\s*$', 1) ELSE 'unknown' END AS zone
    FROM (SELECT DISTINCT metadata_id, captured_at_raw FROM media_metadata) WHERE regexp_matches(captured_at_raw, '^\s*\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}(?:\s*\.\d{1,9})?(?:\s*[+-]\d{2}:\d{2})?\s*$')""")
def camera_dates(spark, sf):
    """Camera date texts as wall clocks with their written offset."""
    m = load(spark, sf, "media_metadata").select("metadata_id", "captured_at_raw").distinct().where(F.col("captured_at_raw").rlike(r"^\s*\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}(?:\s*\.\d{1,9})?(?:\s*[+-]\d{2}:\d{2})?\s*$"))
    return m.select("metadata_id", F.unix_micros(X.camera_wall("captured_at_raw").cast("timestamp")).alias("wall_us"), X.camera_offset("captured_at_raw").alias("zone"))


@query("platform_dates", r"SELECT observed_at, epoch_us(try_cast(regexp_replace(replace(replace(upper(observed_at), 'T', ' '), 'Z', '+00:00'), '([+-]\d{2}):?(\d{2})$', '\1:\2') AS TIMESTAMPTZ)) AS instant_us FROM (SELECT DISTINCT observed_at FROM delivery_source WHERE regexp_matches(observed_at, '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)? ?([Zz]|[+-]\d{2}:?\d{2})$'))")
def platform_dates(spark, sf):
    """Platform timestamps as instants."""
    return load(spark, sf, "delivery_source").select("observed_at").distinct().withColumn("instant_us", F.unix_micros(X.platform_instant("observed_at"))).where("instant_us is not null")


@query("epoch_buckets", f"SELECT floor(captured_at_unix_ms / 86400000.0)::BIGINT AS day, count(*) AS n FROM {ASSETS} WHERE captured_at_unix_ms IS NOT NULL GROUP BY 1")
def epoch_buckets(spark, sf):
    """D3: captures a day, by floor division."""
    return assets(spark, sf).where("captured_at_unix_ms is not null").groupBy(X.bucket("captured_at_unix_ms", 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("json_payload", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total_k FROM events GROUP BY event_type")
def json_payload(spark, sf):
    """A number inside a JSON payload."""
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total_k"))


@query("error_status", "SELECT status, count(*) AS n FROM (SELECT CASE artifact_status WHEN 'unsupported' THEN 'unsupported' WHEN 'corrupt' THEN 'corrupt' WHEN 'failed' THEN 'failed' ELSE 'ready' END AS status FROM media_metadata) GROUP BY status")
def error_status(spark, sf):
    """Copies by the status their error leaves."""
    from ..operators.checks import error_status as status_of

    code = F.when(F.col("artifact_status") == "unsupported", "unsupported_format").when(F.col("artifact_status") == "corrupt", "corrupt_source").when(F.col("artifact_status") == "failed", "io")
    return load(spark, sf, "media_metadata").select(status_of(code).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_map", "SELECT DISTINCT metadata_id, coalesce('exif.lens=' || lens_model || ';', '') || coalesce('exif.model=' || camera_model || ';', '') AS entries FROM media_metadata")
def metadata_map(spark, sf):
    """Camera and lens as entries of the raw-metadata map, as text in key order."""
    from ..operators.checks import merged_map

    m = merged_map(F.lit(None).cast("map<string,string>"), "exif", {"model": F.col("camera_model"), "lens": F.col("lens_model")})
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return load(spark, sf, "media_metadata").select("metadata_id", text.alias("entries")).distinct()


@query("tagged_values", "SELECT asset_id, kind, CASE WHEN kind = 'generic' THEN camera_model END AS generic, CASE WHEN kind = 'phrase' THEN lens_model END AS phrase FROM (SELECT asset_id, camera_model, lens_model, CASE WHEN starred THEN 'phrase' ELSE 'generic' END AS kind FROM " + ASSETS + ")")
def tagged_values(spark, sf):
    """A tagged value for each asset, taken apart again."""
    from ..operators.checks import tagged

    t = tagged(F.when(F.col("starred"), "phrase").otherwise("generic"), generic=F.col("camera_model"), phrase=F.col("lens_model"))
    return assets(spark, sf).select("asset_id", t.alias("t")).select("asset_id", "t.kind", "t.generic", "t.phrase")


@query("nfc_stem", r"""WITH n AS (SELECT file_instance_id, nfc_normalize(split_part(replace(relative_path, '\\', '/'), '/', -1)) AS name FROM delivery_source),
    s AS (SELECT file_instance_id, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem FROM n)
    SELECT DISTINCT file_instance_id, regexp_replace(regexp_replace(lower(stem), '[^\p{L}\p{N}]', '', 'g'), '^(.+?)(edited|edit|retouch|final)$', '\1') AS stem FROM s""")
def nfc_stem(spark, sf):
    """composed, comparable stems of all copies' names."""
    return load(spark, sf, "delivery_source").select("file_instance_id", X.match_stem(X.nfc(X.file_name("relative_path"))).alias("stem")).distinct()


@query("technical_bands", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN s >= 76 THEN 'strong' WHEN s >= 54 THEN 'good' WHEN s >= 30 THEN 'review' WHEN s < 30 THEN 'technical_issue' END AS band FROM (SELECT quality * 100 AS s FROM " + EVIDENCE + ")) GROUP BY band")
def technical_bands(spark, sf):
    """Fingerprints by quality band."""
    return evidence(spark, sf).select(X.quality_band(F.col("quality") * 100, F.lit(0.0), F.lit(0.0)).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("suggestion_confidence", f"SELECT asset_id, round(greatest(0.25, least(0.92, technical_score::DOUBLE * CASE WHEN len(similar_set_ids) > 0 THEN 0.92::DOUBLE ELSE 0.78::DOUBLE END * CASE WHEN anonymous_face_count > 2 THEN 0.88::DOUBLE ELSE 1.0::DOUBLE END)), 6) AS confidence FROM {ASSETS} WHERE technical_score IS NOT NULL")
def suggestion_confidence(spark, sf):
    """Confidence of a suggestion (frames of more than two faces stand for closed eyes)."""
    a = assets(spark, sf).where("technical_score is not null")
    got = X.suggestion_confidence(F.col("technical_score").cast("double"), F.coalesce(F.size("similar_set_ids") > 0, F.lit(False)), F.coalesce(F.col("anonymous_face_count") > 2, F.lit(False)))
    return a.select("asset_id", F.round(got, 6).alias("confidence"))


# groups ----------------------------------------------------------------------

_HEX = lambda c: f"('0x' || {c})::UBIGINT"
_OK = lambda c: f"regexp_full_match({c}, '[0-9a-fA-F]{{16}}')"
_SIM = f"""
    d AS (SELECT c.*, CASE WHEN {_OK('l.perceptual_hash')} AND {_OK('r.perceptual_hash')} THEN bit_count(xor({_HEX('l.perceptual_hash')}, {_HEX('r.perceptual_hash')}))::INT ELSE 64 END AS dist, l.color_signature AS lc, r.color_signature AS rc,
            l.embedding AS le, r.embedding AS re, l.camera_model AS lm, r.camera_model AS rm, l.captured_at_s AS lt, r.captured_at_s AS rt
          FROM c JOIN fe l ON l.project_id = c.project_id AND l.asset_id = c.a JOIN fe r ON r.project_id = c.project_id AND r.asset_id = c.b),
    e AS (SELECT *, CASE WHEN len(lc) > 0 AND len(lc) = len(rc) THEN 1.0::DOUBLE - list_sum(list_transform(list_zip(lc, rc), lambda x: abs(x[1]::INT - x[2]::INT)))::DOUBLE / (len(lc) * 255.0::DOUBLE) ELSE 0.0::DOUBLE END AS cs,
            CASE WHEN len(le) > 0 AND len(le) = len(re) THEN CASE WHEN list_sum(list_transform(le, lambda x: x::INT * x::INT)) > 0 AND list_sum(list_transform(re, lambda x: x::INT * x::INT)) > 0 THEN
                greatest(0.0::DOUBLE, least(1.0::DOUBLE, (list_sum(list_transform(list_zip(le, re), lambda x: x[1]::INT * x[2]::INT))::DOUBLE / (sqrt(list_sum(list_transform(le, lambda x: x::INT * x::INT))::DOUBLE) * sqrt(list_sum(list_transform(re, lambda x: x::INT * x::INT))::DOUBLE)) + 1.0::DOUBLE) / 2.0::DOUBLE))
                ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END AS es FROM d),
    s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - dist / 64.0::DOUBLE) * 0.60::DOUBLE + cs * 0.15::DOUBLE + es * 0.25::DOUBLE)) AS vis FROM e)"""
_FE = f"fe AS {EVIDENCE}"
_BUCKETS = "bk AS (SELECT DISTINCT project_id, asset_id, unnest(bucket_keys) AS bucket FROM fe), bn AS (SELECT project_id, bucket FROM bk GROUP BY ALL HAVING count(*) BETWEEN 2 AND 96), bp AS (SELECT DISTINCT x.project_id, x.asset_id AS a, y.asset_id AS b FROM bk x JOIN bn USING (project_id, bucket) JOIN bk y USING (project_id, bucket) WHERE x.asset_id < y.asset_id)"
_TIMES = "tk AS (SELECT DISTINCT project_id, asset_id, camera_model, floor(captured_at_s / 12.0) AS k FROM fe WHERE captured_at_s IS NOT NULL AND camera_model <> ''), tn AS (SELECT project_id, camera_model, k FROM tk GROUP BY ALL HAVING count(*) BETWEEN 2 AND 96), tp AS (SELECT x.project_id, x.asset_id AS a, y.asset_id AS b FROM tk x JOIN tn USING (project_id, camera_model, k) JOIN tk y USING (project_id, camera_model, k) WHERE x.asset_id < y.asset_id)"
_SMALL = "pn AS (SELECT project_id FROM fe GROUP BY 1 HAVING count(DISTINCT asset_id) <= 256), sp AS (SELECT x.project_id, x.asset_id AS a, y.asset_id AS b FROM fe x JOIN pn USING (project_id) JOIN fe y USING (project_id) WHERE x.asset_id < y.asset_id)"
_CANDS = f"{_BUCKETS}, {_TIMES}, {_SMALL}, c AS (SELECT * FROM bp UNION SELECT * FROM tp UNION SELECT * FROM sp)"
_GATE = "g AS (SELECT *, dist <= 10 AND vis >= 0.86::DOUBLE AS near FROM s WHERE (dist <= 10 AND vis >= 0.86::DOUBLE) OR (dist <= 18 AND vis >= 0.78::DOUBLE AND (coalesce(lm = rm AND lm <> '', false) OR coalesce(abs(lt - rt) <= 120, false))))"


@query("bucket_pairs", f"WITH {_FE}, {_BUCKETS} SELECT project_id, a, b FROM bp")
def bucket_pairs(spark, sf):
    """Candidates that share a hash band of at most 96 members."""
    return G.bucket_pairs(evidence(spark, sf).where("bucket_keys is not null"), F.col("bucket_keys"))


@query("time_pairs", f"WITH {_FE}, {_TIMES} SELECT project_id, a, b FROM tp")
def time_pairs(spark, sf):
    """Candidates of one camera and 12-second bucket."""
    return G.time_pairs(evidence(spark, sf))


@query("theta_pairs_small", "SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_regionkey AS project_id FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def theta_pairs_small(spark, sf):
    """All pairs of small groups."""
    return G.exhaustive_pairs(load(spark, sf, "nation").select(F.col("n_regionkey").alias("project_id"), F.col("n_nationkey").alias("asset_id")))


@query("theta_pairs_projects", f"""WITH f AS (SELECT DISTINCT project_id, asset_id FROM {EVIDENCE}), n AS (SELECT project_id FROM f GROUP BY 1 HAVING count(*) <= 256)
    SELECT x.project_id, x.asset_id AS a, y.asset_id AS b FROM f x JOIN f y ON x.project_id = y.project_id AND x.asset_id < y.asset_id WHERE x.project_id IN (SELECT project_id FROM n)""")
def theta_pairs_projects(spark, sf):
    """All pairs of every project with at most 256 fingerprints; the limit is the operator's own."""
    return G.exhaustive_pairs(evidence(spark, sf))


def _gated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fe = cut(evidence(spark, sf))
    scored = cut(G.score_pairs(G.candidate_pairs(fe), fe))
    return fe, scored, G.gate_pairs(scored)


@query("similarity_gate", f"WITH {_FE}, {_CANDS}, {_SIM}, {_GATE} SELECT project_id, a, b, dist AS perceptual_distance, round(vis, 6) AS visual_similarity, near FROM g")
def similarity_gate(spark, sf):
    """All candidates scored, those within the gates."""
    return _gated(spark, sf)[2].select("project_id", "a", "b", "perceptual_distance", F.round("visual_similarity", 6).alias("visual_similarity"), "near")


@query("pair_diagnostics", f"WITH {_FE}, {_CANDS}, {_SIM}, {_GATE}, x AS (SELECT project_id, count(*) AS n_candidates, min(dist) AS least_distance, max(dist) AS most_distance, round(avg(vis), 6) AS avg_similarity FROM s GROUP BY 1), y AS (SELECT project_id, count(*) AS n_accepted, count(*) FILTER (near) AS n_near FROM g GROUP BY 1) SELECT x.*, coalesce(n_accepted, 0) AS n_accepted, coalesce(n_near, 0) AS n_near FROM x LEFT JOIN y USING (project_id)")
def pair_diagnostics(spark, sf):
    """What the candidates of each project looked like."""
    _, scored, gated = _gated(spark, sf)
    return G.pair_diagnostics(scored, gated)


_REACH = "RE AS (SELECT a AS node, a AS other FROM (SELECT a FROM g UNION SELECT b FROM g) UNION SELECT re.node, ed.b FROM RE re JOIN (SELECT a, b FROM g UNION SELECT b, a FROM g) ed ON ed.a = re.other), lab AS (SELECT node, min(other) AS label FROM RE GROUP BY 1)"
_GROUPS = """
    ge AS (SELECT g.project_id, lab.label, avg(dist) AS ad, avg(vis) AS av, count(*) AS n_pairs FROM g JOIN lab ON lab.node = g.a GROUP BY 1, 2),
    gm AS (SELECT lab.label, count(*) AS n_members, min_by(lab.node, (-coalesce(q.quality, '-infinity'::DOUBLE), lab.node)) AS representative, CASE WHEN count(q.t) = count(*) THEN max(q.t) - min(q.t) END AS span_s
           FROM lab LEFT JOIN (SELECT asset_id, max(quality) AS quality, max(captured_at_s) AS t FROM fe GROUP BY 1) q ON q.asset_id = lab.node GROUP BY 1),
    vg AS (SELECT project_id, label AS first_member, CASE WHEN ad <= 10 AND av >= 0.86::DOUBLE THEN 'near' ELSE 'similar' END AS kind, n_members, n_pairs, representative, span_s FROM ge JOIN gm USING (label))"""


@query("visual_groups", f"WITH RECURSIVE {_FE}, {_CANDS}, {_SIM}, {_GATE}, {_REACH}, {_GROUPS} SELECT * FROM vg")
def visual_groups(spark, sf):
    """A3, A4, A5: near and similar groups with their representative and time span."""
    fe, _, gated = _gated(spark, sf)
    return G.visual_groups(gated, fe)[0].select("project_id", "first_member", "kind", "n_members", "n_pairs", "representative", "span_s")


_EXACT = "xg AS (SELECT project_id, verified_content_hash AS hash, count(DISTINCT asset_id) AS n_members, min(asset_id) AS first_member FROM fe WHERE verified_content_hash <> '' GROUP BY 1, 2 HAVING count(DISTINCT asset_id) > 1)"


@query("exact_groups", f"WITH {_FE}, {_EXACT} SELECT * FROM xg")
def exact_groups(spark, sf):
    """A1: exact duplicates by verified hash."""
    return G.exact_groups(evidence(spark, sf))


@query("exact_duplicates", "SELECT md5(text) AS hash, count(*) AS n_members, min(doc_id) AS first_member FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    """A1: documents of the same text."""
    d = load(spark, sf, "documents").where("text != ''").select(F.lit("").alias("project_id"), F.col("doc_id").alias("asset_id"), F.md5("text").alias("verified_content_hash"))
    return G.exact_groups(d).drop("project_id")


@query("primary_group", f"""WITH RECURSIVE {_FE}, {_CANDS}, {_SIM}, {_GATE}, {_REACH}, {_GROUPS}, {_EXACT},
    m AS (SELECT lab.node AS asset_id, vg.kind, 'v:' || vg.first_member AS group_key FROM lab JOIN vg ON vg.first_member = lab.label UNION SELECT fe.asset_id, 'exact', 'x:' || xg.hash FROM fe JOIN xg ON fe.project_id = xg.project_id AND fe.verified_content_hash = xg.hash)
    SELECT asset_id, kind, group_key FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE kind WHEN 'exact' THEN 0 WHEN 'near' THEN 1 WHEN 'burst' THEN 2 ELSE 3 END, group_key) AS r FROM m) WHERE r = 1""")
def primary_group(spark, sf):
    """Each asset's first group of the union of exact and visual ones."""
    fe, _, gated = _gated(spark, sf)
    groups, members = G.visual_groups(gated, fe)
    exact = fe.join(G.exact_groups(fe).select("project_id", F.col("hash").alias("verified_content_hash")), ["project_id", "verified_content_hash"]).select("asset_id", F.lit("exact").alias("kind"), F.concat(F.lit("x:"), "verified_content_hash").alias("group_key"))
    visual = members.join(groups.select("project_id", "first_member", "kind"), ["project_id", "first_member"]).select("asset_id", "kind", F.concat(F.lit("v:"), "first_member").alias("group_key"))
    return G.primary_groups(visual.unionByName(exact).distinct())


@query("burst_groups", f"""WITH {_FE}, bu AS (SELECT project_id, camera_model, floor(captured_at_s / 10.0)::BIGINT AS bucket, count(*) AS n_members, min(asset_id) AS first_member, max(captured_at_s) - min(captured_at_s) AS span_s FROM fe WHERE captured_at_s IS NOT NULL AND camera_model <> '' GROUP BY 1, 2, 3
        HAVING count(*) BETWEEN 3 AND 96 AND max(captured_at_s) - min(captured_at_s) <= 12),
    m AS (SELECT fe.project_id, fe.camera_model, floor(fe.captured_at_s / 10.0)::BIGINT AS bucket, fe.asset_id FROM fe), c AS (SELECT x.project_id, x.asset_id AS a, y.asset_id AS b, x.camera_model, x.bucket FROM m x JOIN bu USING (project_id, camera_model, bucket) JOIN m y USING (project_id, camera_model, bucket) WHERE x.asset_id < y.asset_id), {_SIM}
    SELECT bu.project_id, bu.camera_model, bu.bucket, n_members, first_member, span_s, round(avg(vis), 6) AS avg_similarity FROM bu JOIN s ON s.project_id = bu.project_id AND s.camera_model = bu.camera_model AND s.bucket = bu.bucket GROUP BY ALL HAVING avg(vis) >= 0.78::DOUBLE""")
def burst_groups(spark, sf):
    """A2: bursts within ten-second buckets."""
    return G.burst_groups(cut(evidence(spark, sf))).select("project_id", "camera_model", "bucket", "n_members", "first_member", "span_s", F.round("avg_similarity", 6).alias("avg_similarity"))


@query("stale_scores", f"""WITH {_FE}, k AS (SELECT project_id, least(left_asset_id, right_asset_id) AS a, greatest(left_asset_id, right_asset_id) AS b, computed_at, perceptual_distance AS pd, visual_similarity AS vs FROM similarity_evidence WHERE left_asset_id <> right_asset_id),
    c AS (SELECT project_id, a, b, pd, vs FROM (SELECT *, row_number() OVER (PARTITION BY project_id, a, b ORDER BY computed_at DESC NULLS LAST, pd DESC NULLS LAST, vs DESC NULLS LAST) AS r FROM k) WHERE r = 1), {_SIM}
    SELECT project_id, a, b, NOT coalesce(pd = dist AND abs(vs - vis) <= 1e-6::DOUBLE, false) AS stale FROM s""")
def stale_scores(spark, sf):
    """Stored pair scores that the fingerprints contradict."""
    return G.stale_scores(load(spark, sf, "similarity_evidence"), evidence(spark, sf)).select("project_id", "a", "b", "stale")


@query("hamming_histogram", f"WITH h AS (SELECT CASE WHEN {_OK('x.perceptual_hash')} AND {_OK('y.perceptual_hash')} THEN bit_count(xor({_HEX('x.perceptual_hash')}, {_HEX('y.perceptual_hash')}))::INT ELSE 64 END AS distance FROM (SELECT DISTINCT project_id, left_asset_id, right_asset_id FROM similarity_evidence) s JOIN {EVIDENCE} x ON x.asset_id = s.left_asset_id JOIN {EVIDENCE} y ON y.asset_id = s.right_asset_id) SELECT distance, count(*) AS n FROM h GROUP BY 1")
def hamming_histogram(spark, sf):
    """H1: hash distances of the stored pairs."""
    h = evidence(spark, sf).select("asset_id", "perceptual_hash")
    s = load(spark, sf, "similarity_evidence").select("project_id", "left_asset_id", "right_asset_id").distinct()
    both = s.join(h.select(F.col("asset_id").alias("left_asset_id"), F.col("perceptual_hash").alias("x")), "left_asset_id").join(h.select(F.col("asset_id").alias("right_asset_id"), F.col("perceptual_hash").alias("y")), "right_asset_id")
    return both.groupBy(hamming("x", "y").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query("components", "WITH RECURSIVE e AS (SELECT left_asset_id AS a, right_asset_id AS b FROM similarity_evidence WHERE left_asset_id IS NOT NULL AND right_asset_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS label FROM r GROUP BY node")
def components(spark, sf):
    """A3: components of the stored pairs."""
    return connected_components(load(spark, sf, "similarity_evidence"), "left_asset_id", "right_asset_id")


@query("cascade_match", r"""
    WITH i AS (SELECT DISTINCT file_instance_id AS item_id, relative_path AS p, CASE WHEN trim(content_checksum) <> '' THEN content_checksum END AS c FROM delivery_source WHERE verified),
    o AS (SELECT output_id, p, c FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY p NULLS FIRST, c NULLS FIRST) AS r FROM (SELECT file_instance_id AS output_id, relative_path AS p, CASE WHEN trim(content_checksum) <> '' THEN content_checksum END AS c FROM delivery_source WHERE NOT verified)) WHERE r = 1),
    ik AS (SELECT item_id, lower(p) AS k1, c AS k2, lower(split_part(p, '/', -1)) AS k3, regexp_replace(regexp_replace(lower(regexp_replace(split_part(p, '/', -1), '^(.+)\.[^.]*$', '\1')), '[^\p{L}\p{N}]', '', 'g'), '^(.+?)(edited|edit|retouch|final)$', '\1') AS k4 FROM i),
    ok AS (SELECT output_id, lower(p) AS k1, c AS k2, lower(split_part(p, '/', -1)) AS k3, regexp_replace(regexp_replace(lower(regexp_replace(split_part(p, '/', -1), '^(.+)\.[^.]*$', '\1')), '[^\p{L}\p{N}]', '', 'g'), '^(.+?)(edited|edit|retouch|final)$', '\1') AS k4 FROM o),
    hits AS (SELECT output_id, 1 AS lv, 'path' AS level, ik.item_id FROM ok JOIN ik ON ok.k1 = ik.k1 UNION ALL SELECT output_id, 2, 'checksum', ik.item_id FROM ok JOIN ik ON ok.k2 = ik.k2 UNION ALL SELECT output_id, 3, 'filename', ik.item_id FROM ok JOIN ik ON ok.k3 = ik.k3 UNION ALL SELECT output_id, 4, 'stem', ik.item_id FROM ok JOIN ik ON ok.k4 = ik.k4),
    n AS (SELECT output_id, lv, level, count(DISTINCT item_id) AS n FROM hits GROUP BY 1, 2, 3), f AS (SELECT output_id, level, n FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY lv) AS r FROM n) WHERE r = 1)
    SELECT level, state, count(*) AS n_outputs, sum(nc)::BIGINT AS n_candidates FROM (SELECT o2.output_id, f.level, coalesce(f.n, 0) AS nc, CASE WHEN f.n IS NULL THEN 'unmatched' WHEN f.n > 1 THEN 'ambiguous' WHEN f.level IN ('path', 'checksum') THEN 'linked' ELSE 'suggested' END AS state
        FROM (SELECT DISTINCT output_id FROM o) o2 LEFT JOIN f USING (output_id)) GROUP BY 1, 2""")
def cascade_match(spark, sf):
    """Unverified copies matched to verified ones: path, checksum, name, stem."""
    d = load(spark, sf, "delivery_source").withColumn("checksum", F.when(F.trim("content_checksum") != "", F.col("content_checksum")))
    items = d.where("verified").select(F.col("file_instance_id").alias("item_id"), F.col("relative_path").alias("path"), "checksum").distinct()
    outs = d.where("not verified").groupBy(F.col("file_instance_id").alias("output_id")).agg(F.min(F.struct(F.col("relative_path").alias("path"), "checksum")).alias("m")).select("output_id", "m.path", "m.checksum")
    return matching.cascade_match(outs, items).groupBy("level", "state").agg(F.count(F.lit(1)).alias("n_outputs"), F.sum("n_candidates").alias("n_candidates"))


QUERIES = Q
ORACLE = SQL
