"""Queries of the general data problems: sessions (p2) and capture times (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.captime import ABBREVIATIONS
from ..operators.sessions import cut_sessions, gap_tree, latest_per_key
from ..operators.timestamps import choose_by_order, with_interpretations
from ..session import cut, load

PAUSE_MS = 30 * 60 * 1000
PROFILE_MS = (5 * 60 * 1000, PAUSE_MS, 2 * 60 * 60 * 1000, 24 * 60 * 60 * 1000)


def _exposures(spark: SparkSession, sf: str) -> DataFrame:
    """The counting row of each asset: the one with the latest ``ingested_at``."""
    t = load(spark, sf, "timeline_asset").select("asset_id", "ingested_at", "capture_device_id", "captured_at_unix_ms")
    return latest_per_key(t, "asset_id", "ingested_at", ["capture_device_id", "captured_at_unix_ms"])


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """The gap tree of each capture device, for any pause from the shortest to the longest of ``PROFILE_MS``."""
    return gap_tree(_exposures(spark, sf), "capture_device_id", "captured_at_unix_ms", pauses=(min(PROFILE_MS), max(PROFILE_MS)))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each capture device, cut from its gap tree at 30 minutes."""
    return cut_sessions(_tree(spark, sf), PAUSE_MS).select(
        F.col("entity").alias("capture_device_id"), F.col("start").alias("session_start_ms"), F.col("end").alias("session_end_ms"), F.col("n").alias("n_assets")
    )


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions, mean length and size for several pauses, all from one tree."""
    tree = cut(_tree(spark, sf))
    pause = F.explode(F.array(*[F.lit(p) for p in PROFILE_MS]))
    hit = (F.col("height") <= F.col("pause_ms")) & (F.col("parent_gap").isNull() | (F.col("parent_gap") > F.col("pause_ms")))
    return (
        tree.withColumn("pause_ms", pause).where(hit).groupBy("pause_ms")
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_assets"), F.max("n").alias("largest"), F.sum(F.col("end") - F.col("start")).alias("total_ms"))
    )


def _capture_times(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables as records of written times; rows repeated whole count once."""
    meta = load(spark, sf, "media_metadata").select(
        F.lit("metadata").alias("kind"), F.col("metadata_id").alias("record_id"), F.col("captured_at_raw").alias("value"),
        F.col("capture_timezone").alias("zone"), F.col("capture_time_source").alias("tag"), F.unix_micros("observed_at").alias("seq"),
    )
    cand = load(spark, sf, "capture_time_candidate").select(
        F.lit("candidate").alias("kind"), F.col("candidate_id").alias("record_id"), F.col("local_value").alias("value"),
        F.col("tz_value").alias("zone"), F.col("source_tag").alias("tag"), F.unix_micros("observed_at").alias("seq"),
    )
    rows = meta.unionByName(cand).where("record_id is not null and value is not null")
    first = F.min(F.struct("value", "zone", "tag", "seq")).alias("r")
    once = rows.groupBy("kind", "record_id").agg(first).select("kind", "record_id", "r.*")
    return once.select("kind", "record_id", F.concat_ws("/", "kind", "tag").alias("source"), "seq", "value", "zone")


def _path(spark: SparkSession, sf: str, slash_orders: tuple[str, ...]) -> DataFrame:
    return choose_by_order(_capture_times(spark, sf), read=lambda rows: with_interpretations(rows, "value", "zone", slash_orders))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The instants that value and zone determine: the steps of the path search that had no alternative.

    Slash dates are month first; wall times that occur twice have two
    interpretations and are left out.
    """
    chosen = _path(spark, sf, ("mdy",))
    return chosen.where("n_valid = 1").select(F.col("kind").alias("record_kind"), "record_id", "utc_us")


def p3_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with a valid interpretation, slash dates in either order; where several are, the order of its source chose."""
    return _path(spark, sf, ("mdy", "dmy")).select(F.col("kind").alias("record_kind"), "record_id", "utc_us", "format", "n_valid")


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p3_found": p3_found, "p3_resolved": p3_resolved}

_LATEST = """
    SELECT capture_device_id AS d, captured_at_unix_ms AS t FROM (
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ingested_at DESC NULLS LAST,
            capture_device_id DESC NULLS LAST, captured_at_unix_ms DESC NULLS LAST) AS rn
        FROM timeline_asset WHERE asset_id IS NOT NULL)
    WHERE rn = 1 AND capture_device_id IS NOT NULL AND captured_at_unix_ms IS NOT NULL"""

ORACLE = {
    "p2_found": f"""
        WITH e AS ({_LATEST}),
        g AS (SELECT d, t, CASE WHEN t - lag(t) OVER (PARTITION BY d ORDER BY t) <= {PAUSE_MS} THEN 0 ELSE 1 END AS starts FROM e),
        s AS (SELECT d, t, sum(starts) OVER (PARTITION BY d ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT d AS capture_device_id, min(t) AS session_start_ms, max(t) AS session_end_ms, count(*) AS n_assets FROM s GROUP BY d, k""",
    "p2_profile": f"""
        WITH e AS ({_LATEST}),
        p AS (SELECT unnest([{', '.join(map(str, PROFILE_MS))}]) AS pause_ms),
        x AS (SELECT d, t, lag(t) OVER (PARTITION BY d ORDER BY t) AS before FROM e),
        g AS (SELECT pause_ms, d, t, CASE WHEN t - before <= pause_ms THEN 0 ELSE 1 END AS starts FROM x, p),
        s AS (SELECT pause_ms, d, t, sum(starts) OVER (PARTITION BY pause_ms, d ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
        z AS (SELECT pause_ms, d, k, max(t) - min(t) AS ms, count(*) AS n FROM s GROUP BY pause_ms, d, k)
        SELECT pause_ms, count(*) AS n_sessions, sum(n)::BIGINT AS n_assets, max(n) AS largest, sum(ms)::BIGINT AS total_ms FROM z GROUP BY pause_ms""",
}

# Read by patterns and the database's own zones: of the wall times of a region those are kept that exactly one instant shows.
_EAST = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\s*[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?\s*(.*)$"
_NAMES = "['a','b','c','H','M','S','f','ap','z']"
ORACLE["p3_found"] = rf"""WITH rows AS (
      SELECT 'metadata' AS record_kind, metadata_id AS record_id, captured_at_raw AS v, capture_timezone AS tz, capture_time_source AS tag, observed_at AS t FROM media_metadata
      UNION ALL SELECT 'candidate', candidate_id, local_value, tz_value, source_tag, observed_at FROM capture_time_candidate),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_kind, record_id ORDER BY v, tz NULLS FIRST, tag NULLS FIRST, t NULLS FIRST) AS rn FROM rows WHERE record_id IS NOT NULL AND v IS NOT NULL) WHERE rn = 1),
    c AS (SELECT record_kind, record_id, trim(regexp_replace(regexp_replace(v, '[\x00-\x08\x0e-\x1f\x7f\x{{feff}}]', '', 'g'), '[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}]+', ' ', 'g')) AS v, tz FROM one),
    num AS (SELECT record_kind, record_id, regexp_extract(v, '^(\d{{9,10}}|\d{{12,13}}|\d{{15,16}}|\d{{18,19}})(?:[.,](\d+))?$', ['w', 'f']) AS x FROM c WHERE regexp_full_match(v, '(\d{{9,10}}|\d{{12,13}}|\d{{15,16}}|\d{{18,19}})([.,]\d+)?')),
    epoch AS (SELECT record_kind, record_id, CASE WHEN len(x.w) >= 18 THEN x.w::BIGINT // 1000 WHEN len(x.w) >= 15 THEN x.w::BIGINT WHEN len(x.w) >= 12 THEN x.w::BIGINT * 1000 + rpad(left(x.f, 3), 3, '0')::BIGINT ELSE x.w::BIGINT * 1000000 + rpad(left(x.f, 6), 6, '0')::BIGINT END AS us FROM num),
    shaped AS (SELECT record_kind, record_id, tz, CASE
          WHEN regexp_matches(v, '^\d{{4}}[:/.-]\d{{1,2}}[:/.-]\d{{1,2}}(\s*[Tt]\s*|\s+)\d{{1,2}}:\d{{2}}') THEN 'ymd' WHEN regexp_matches(v, '^\d{{8}}[Tt_ -]?\d{{4}}(\d{{2}})?([.,]\d+)?([^\d]|$)') THEN 'compact'
          WHEN regexp_matches(v, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}(\s*[Tt,]\s*|\s+)\d{{1,2}}:\d{{2}}') THEN 'slash' WHEN regexp_matches(v, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(\s*[Tt,]\s*|\s+)\d{{1,2}}:\d{{2}}') THEN 'dotted'
          WHEN regexp_matches(v, '^([A-Za-z]{{3}},\s*)?\d{{1,2}}\s+[A-Za-z]{{3,}}\s+\d{{4}}\s+\d{{1,2}}:\d{{2}}') THEN 'mail' END AS shape, v FROM c ANTI JOIN num USING (record_kind, record_id)),
    parts AS (SELECT record_kind, record_id, tz, shape, CASE shape
          WHEN 'ymd' THEN regexp_extract(v, '^(\d{{4}})[:/.-](\d{{1,2}})[:/.-](\d{{1,2}})(?:\s*[Tt]\s*|\s+){_CLOCK}', {_NAMES}) WHEN 'compact' THEN regexp_extract(v, '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ -]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?()\s*(.*)$', {_NAMES})
          WHEN 'slash' THEN regexp_extract(v, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:\s*[Tt,]\s*|\s+){_CLOCK}', {_NAMES}) WHEN 'dotted' THEN regexp_extract(v, '^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:\s*[Tt,]\s*|\s+){_CLOCK}', {_NAMES})
          WHEN 'mail' THEN regexp_extract(v, '^(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{4}})\s+{_CLOCK}', {_NAMES}) END AS x FROM shaped WHERE shape IS NOT NULL AND (shape <> 'ymd' OR v[5] = regexp_extract(v, '^\d{{4}}.\d{{1,2}}(.)', 1))),
    dated AS (SELECT *, CASE WHEN shape IN ('ymd', 'compact') THEN x.a ELSE x.c END AS y, CASE shape WHEN 'slash' THEN x.a WHEN 'mail' THEN nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(x.b)), 0)::VARCHAR ELSE x.b END AS m,
          CASE WHEN shape IN ('ymd', 'compact') THEN x.c WHEN shape = 'slash' THEN x.b ELSE x.a END AS d, CASE WHEN x.ap = '' THEN try_cast(x.H AS INT) WHEN try_cast(x.H AS INT) BETWEEN 1 AND 12 THEN try_cast(x.H AS INT) % 12 + CASE WHEN lower(x.ap) = 'p' THEN 12 ELSE 0 END END AS h,
          CASE WHEN regexp_matches(x.z, '^.*\[[^\]]*\]$') THEN coalesce(nullif(trim(regexp_extract(x.z, '^(.*?)\s*\[([^\]]*)\]$', 1)), ''), regexp_extract(x.z, '^(.*?)\s*\[([^\]]*)\]$', 2)) WHEN trim(x.z) <> '' THEN x.z ELSE tz END AS zone FROM parts WHERE x.H <> ''),
    walls AS (SELECT record_kind, record_id, try_cast(lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(h::VARCHAR, 2, '0') || ':' || x.M || ':' || CASE WHEN x.S = '' THEN '00' ELSE x.S END AS TIMESTAMP) AS wall, h, x.S AS s, rpad(left(x.f, 6), 6, '0')::BIGINT AS us,
          trim(regexp_replace(regexp_replace(replace(replace(zone, chr(8722), '-'), chr(8211), '-'), '[\x00-\x08\x0e-\x1f\x7f\x{{feff}}]', '', 'g'), '[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}]+', ' ', 'g')) AS zone FROM dated WHERE h < 24 AND try_cast(x.M AS INT) < 60 AND (x.S = '' OR try_cast(x.S AS INT) < 60)),
    ab(name, east) AS (VALUES {_EAST}), reg AS (SELECT DISTINCT lower(name) AS low, first(name) AS name FROM pg_timezone_names() WHERE contains(name, '/') AND NOT regexp_matches(lower(name), '^(posix|right|systemv)/') GROUP BY 1),
    placed AS (SELECT w.*, coalesce(ab.east, CASE WHEN regexp_matches(zone, '(?i)^(utc|gmt)?\s*[+-]\d{{1,2}}(:?\d{{2}})?$') THEN CASE WHEN mi < 60 AND hh * 60 + mi <= 840 THEN (hh * 60 + mi) * CASE WHEN contains(zone, '-') THEN -1 ELSE 1 END ELSE NULL END END) AS east, reg.name AS region
          FROM (SELECT *, coalesce(try_cast(regexp_extract(zone, '[+-](\d{{1,2}}):?(\d{{2}})?$', 1) AS INT), 0) AS hh, coalesce(try_cast(regexp_extract(zone, '[+-](\d{{1,2}}):?(\d{{2}})?$', 2) AS INT), 0) AS mi FROM walls WHERE wall IS NOT NULL AND zone <> '') w
          LEFT JOIN ab ON ab.name = upper(zone) LEFT JOIN reg ON reg.low = replace(lower(zone), ' ', '_')),
    fixed AS (SELECT record_kind, record_id, epoch_us(wall) - east * 60000000::BIGINT + us AS utc_us FROM placed WHERE east IS NOT NULL),
    guess AS (SELECT DISTINCT record_kind, record_id, us, epoch_us(timezone(region, wall)) + unnest([-7200, -5400, -3600, -1800, 0, 1800, 3600, 5400, 7200]) * 1000000::BIGINT AS inst, region, wall FROM placed WHERE east IS NULL AND region IS NOT NULL),
    hits AS (SELECT record_kind, record_id, min(inst) + any_value(us) AS utc_us, count(*) AS n FROM guess WHERE timezone(region, make_timestamptz(inst)) = wall GROUP BY 1, 2)
    SELECT record_kind, record_id, us AS utc_us FROM epoch UNION ALL SELECT * FROM fixed UNION ALL SELECT record_kind, record_id, utc_us FROM hits WHERE n = 1"""
