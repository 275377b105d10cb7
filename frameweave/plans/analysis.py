"""Queries of the timeline, vector, evaluation and preference operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import metrics, prefs as P, timeline as T, vectors as V
from ..session import cut, few_or_merged, load
from .catalogue import ASSETS, assets

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# timeline --------------------------------------------------------------------

_T = f"t AS (SELECT * FROM {ASSETS} WHERE project_id IS NOT NULL AND captured_at_unix_ms IS NOT NULL)"
_W = "WINDOW w AS (PARTITION BY project_id ORDER BY captured_at_unix_ms, asset_id)"
_GAPS = f"{_T}, gp AS (SELECT project_id, asset_id, lag(asset_id) OVER w AS prev_asset_id, captured_at_unix_ms - lag(captured_at_unix_ms) OVER w AS gap_ms FROM t {_W})"
_CADENCE = f"""{_GAPS}, pg AS (SELECT project_id, gap_ms, row_number() OVER (PARTITION BY project_id ORDER BY gap_ms) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM gp WHERE gap_ms > 0),
    pc AS (SELECT project_id, max(n) AS n, min(CASE WHEN i >= greatest(ceil(n * 0.5::DOUBLE), 1) THEN gap_ms END) AS med, min(CASE WHEN i >= greatest(ceil(n * 0.9::DOUBLE), 1) THEN gap_ms END) AS p90 FROM pg GROUP BY project_id),
    cad AS (SELECT project_id, n AS positive_gap_samples, CASE WHEN n >= 3 THEN med END AS median_gap_ms, CASE WHEN n >= 3 THEN p90 END AS p90_gap_ms, CASE WHEN n >= 3 THEN greatest(p90, 2 * med, 1) END AS normalizer_gap_ms FROM pc)"""
COLS = [*T.COLUMNS, "decision", "rating", "starred", "technical_score"]


def _line(spark: SparkSession, sf: str) -> DataFrame:
    return T.timeline(assets(spark, sf), COLS)


@query("cadence", f"WITH {_CADENCE} SELECT * FROM cad")
def cadence(spark, sf):
    """The capture cadence of each project."""
    return T.cadence(T.gaps(_line(spark, sf)))


@query("timeline_gaps", f"WITH {_CADENCE} SELECT project_id, prev_asset_id AS after_asset_id, asset_id AS before_asset_id, gap_ms FROM gp JOIN cad USING (project_id) WHERE gap_ms > normalizer_gap_ms")
def timeline_gaps(spark, sf):
    """Gaps longer than the project's normalizer."""
    g = cut(T.gaps(_line(spark, sf)).select("project_id", "asset_id", "prev_asset_id", "gap_ms"))
    return T.timeline_gaps(g, T.cadence(g))


def _lag(c: str) -> str:
    return f"lag({c}) OVER w AS p_{c}"


_S = "::DOUBLE"
_BOUND = f"""{_CADENCE}, l AS (SELECT *, {', '.join(_lag(c) for c in ('asset_id', 'captured_at_unix_ms', *T.COLUMNS))} FROM t {_W}),
    x AS (SELECT l.*, c.normalizer_gap_ms AS nz, captured_at_unix_ms - p_captured_at_unix_ms AS gap, nullif(lower(trim(camera_model)), '') AS c1, nullif(lower(trim(p_camera_model)), '') AS c0, nullif(lower(trim(lens_model)), '') AS l1, nullif(lower(trim(p_lens_model)), '') AS l0,
        abs(anonymous_face_count - p_anonymous_face_count) AS fd, abs(filename_sequence - p_filename_sequence) AS sd, coalesce(list_has_any(list_filter(similar_set_ids, lambda s: trim(s) <> ''), list_filter(p_similar_set_ids, lambda s: trim(s) <> '')), false) AS shared
        FROM l LEFT JOIN cad c USING (project_id) WHERE p_asset_id IS NOT NULL),
    y AS (SELECT *, (c0 IS NOT NULL AND c1 IS NOT NULL)::INT + (l0 IS NOT NULL AND l1 IS NOT NULL)::INT AS comparable, coalesce(c0 <> c1, false)::INT + coalesce(l0 <> l1, false)::INT AS changed FROM x),
    z AS (SELECT *, CASE WHEN nz IS NOT NULL THEN 0.36{_S} ELSE 0 END AS w1, CASE WHEN nz IS NOT NULL THEN 0.36{_S} * (2 * least(gap::DOUBLE / nz, 1.0{_S}) - 1) ELSE 0 END AS n1,
        CASE WHEN comparable > 0 THEN 0.10{_S} ELSE 0 END AS w2, CASE WHEN comparable > 0 THEN 0.10{_S} * CASE WHEN changed = 0 THEN -0.70{_S} ELSE changed::DOUBLE / comparable END ELSE 0 END AS n2,
        CASE WHEN orientation IS NOT NULL AND p_orientation IS NOT NULL THEN 0.06{_S} ELSE 0 END AS w3, CASE WHEN orientation = p_orientation THEN 0.06{_S} * -0.60{_S} WHEN orientation <> p_orientation THEN 0.06{_S} * 0.80{_S} ELSE 0 END AS n3,
        CASE WHEN fd IS NOT NULL THEN 0.04{_S} ELSE 0 END AS w4, CASE WHEN fd = 0 THEN 0.04{_S} * -0.45{_S} WHEN fd = 1 THEN 0.04{_S} * 0.25{_S} WHEN fd = 2 THEN 0.04{_S} * 0.45{_S} WHEN fd > 2 THEN 0.04{_S} * 0.60{_S} ELSE 0 END AS n4,
        CASE WHEN shared THEN 0.08{_S} ELSE 0 END AS w5, CASE WHEN shared THEN 0.08{_S} * -0.90{_S} ELSE 0 END AS n5,
        CASE WHEN sd <= 1 OR sd >= 12 THEN 0.02{_S} ELSE 0 END AS w6, CASE WHEN sd <= 1 THEN 0.02{_S} * -0.25{_S} WHEN sd >= 12 THEN 0.02{_S} * 0.10{_S} ELSE 0 END AS n6 FROM y),
    sc AS (SELECT *, CASE WHEN w1 + w2 + w3 + w4 + w5 + w6 > 0 THEN least(1.0{_S}, greatest(0.0{_S}, (n1 + n2 + n3 + n4 + n5 + n6) / (w1 + w2 + w3 + w4 + w5 + w6))) END AS score FROM z),
    bo AS (SELECT project_id, p_asset_id AS left_asset_id, asset_id AS right_asset_id, score, CASE WHEN score IS NULL THEN 'insufficient' WHEN score >= 0.60{_S} THEN 'strong' WHEN score >= 0.32{_S} THEN 'moderate' ELSE 'continuous' END AS category FROM sc)"""
_SEGMENT = f"""{_BOUND}, sg AS (SELECT t.*, sum(coalesce(b.st, 0)) OVER (PARTITION BY t.project_id ORDER BY captured_at_unix_ms, asset_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
    FROM t LEFT JOIN (SELECT project_id, right_asset_id AS asset_id, 1 AS st FROM bo WHERE category IN ('moderate', 'strong')) b USING (project_id, asset_id))"""


def _bounds(spark: SparkSession, sf: str, only: tuple[str, ...] | None = None, semantic: bool = False) -> tuple[DataFrame, DataFrame]:
    line = _line(spark, sf)
    sem = None
    if semantic:
        named = load(spark, sf, "semantic_vector").where("asset_id is not null and compatibility_key is not null")
        vec = named.groupBy("asset_id", F.col("compatibility_key").alias("key")).agg(F.max(F.struct("embedded_at", "vector_values")).alias("v")).select("asset_id", "key", F.col("v.vector_values").alias("vector"))
        sem = T.context_similarity_by_key(line, cut(vec))
    pairs = cut(T.gaps(line, T.COLUMNS))
    return line, cut(T.boundaries(pairs, T.cadence(pairs), sem, only=only))


@query("boundaries", f"WITH {_BOUND} SELECT project_id, left_asset_id, right_asset_id, round(score, 6) AS score, category FROM bo")
def boundaries(spark, sf):
    """Every adjacent pair with its combined score (no semantic signal)."""
    return _bounds(spark, sf)[1].withColumn("score", F.round("score", 6))


@query("boundaries_time_only", f"WITH {_CADENCE} SELECT project_id, prev_asset_id AS left_asset_id, asset_id AS right_asset_id, CASE WHEN normalizer_gap_ms IS NOT NULL THEN round(greatest(0.0::DOUBLE, 2 * least(gap_ms::DOUBLE / normalizer_gap_ms, 1.0::DOUBLE) - 1), 6) END AS score FROM gp LEFT JOIN cad USING (project_id) WHERE prev_asset_id IS NOT NULL")
def boundaries_time_only(spark, sf):
    """The time signal alone."""
    return _bounds(spark, sf, ("time_gap",))[1].select("project_id", "left_asset_id", "right_asset_id", F.round("score", 6).alias("score"))


@query("boundary_explanations", f"""WITH {_BOUND}, n AS (SELECT bo.project_id, right_asset_id, category, array_to_string(list_filter([CASE WHEN nz IS NOT NULL AND gap > 0 THEN 'time gap' END, CASE WHEN changed > 0 THEN 'camera lens' END, CASE WHEN orientation <> p_orientation THEN 'orientation' END, CASE WHEN fd > 0 THEN 'faces' END, CASE WHEN sd >= 12 THEN 'filename' END], lambda x: x IS NOT NULL), ', ') AS pro,
    array_to_string(list_filter([CASE WHEN nz IS NOT NULL AND gap < nz THEN 'time gap' END, CASE WHEN comparable > 0 AND changed = 0 THEN 'camera lens' END, CASE WHEN orientation = p_orientation THEN 'orientation' END, CASE WHEN fd = 0 THEN 'faces' END, CASE WHEN shared THEN 'similar sets' END, CASE WHEN sd <= 1 THEN 'filename' END], lambda x: x IS NOT NULL), ', ') AS con
    FROM bo JOIN sc ON sc.project_id = bo.project_id AND sc.asset_id = bo.right_asset_id) SELECT project_id, right_asset_id, category || ' boundary; for: ' || CASE WHEN pro = '' THEN 'none' ELSE pro END || '; against: ' || CASE WHEN con = '' THEN 'none' ELSE con END AS explanation FROM n""")
def boundary_explanations(spark, sf):
    """what speaks for and against each boundary."""
    from ..operators.checks import explain_boundary

    line, found = _bounds(spark, sf)
    pairs = T.neighbours(line, "project_id", T.ORDER, ["captured_at_unix_ms", "asset_id", *T.COLUMNS]).where("prev_asset_id is not null")
    pairs = pairs.join(T.cadence(T.gaps(line)).select("project_id", "normalizer_gap_ms"), "project_id", "left").withColumn("semantic_similarity", F.lit(None).cast("double"))
    both = pairs.join(found.select("project_id", F.col("right_asset_id").alias("asset_id"), "category"), ["project_id", "asset_id"])
    return both.select("project_id", F.col("asset_id").alias("right_asset_id"), explain_boundary("category", T.signals()).alias("explanation"))


# Contexts as lists of up to four vectors on either side of each pair, for every key of a project.
_CONTEXT = """vec AS (SELECT asset_id, compatibility_key AS key, vector_values::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, compatibility_key ORDER BY embedded_at DESC NULLS LAST, vector_values DESC NULLS LAST) AS n
        FROM semantic_vector WHERE asset_id IS NOT NULL AND compatibility_key IS NOT NULL) WHERE n = 1),
    ks AS (SELECT DISTINCT project_id, key FROM t JOIN vec USING (asset_id)),
    ln AS (SELECT t.project_id, ks.key, t.asset_id, captured_at_unix_ms AS at_ms, {'ok': coalesce(len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0, false), 'd': len(v), 'v': v} AS item
        FROM t JOIN ks ON ks.project_id = t.project_id LEFT JOIN vec ON vec.asset_id = t.asset_id AND vec.key = ks.key),
    fr AS (SELECT project_id, key, asset_id, list_reverse(list(item) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS l, list(item) OVER (o ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r FROM ln WINDOW o AS (PARTITION BY project_id, key ORDER BY at_ms, asset_id)),
    fc AS (SELECT *, l[1].d AS d FROM fr WHERE l[1].ok),
    cu AS (SELECT project_id, key, asset_id, l[1:coalesce(nullif(list_position(list_transform(l, lambda x: x.ok AND x.d = d), false), 0) - 1, len(l))] AS l, r[1:coalesce(nullif(list_position(list_transform(r, lambda x: x.ok AND x.d = d), false), 0) - 1, len(r))] AS r FROM fc),
    ce AS (SELECT project_id, key, asset_id, len(l) + len(r) AS n, list_reduce(list_transform(l, lambda x: x.v), lambda a, b: list_transform(list_zip(a, b), lambda p: p[1] + p[2])) AS a, list_reduce(list_transform(r, lambda x: x.v), lambda a, b: list_transform(list_zip(a, b), lambda p: p[1] + p[2])) AS b FROM cu WHERE len(l) > 0 AND len(r) > 0),
    co AS (SELECT project_id, key, asset_id, n, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS sim FROM ce WHERE list_dot_product(a, a) > 0 AND list_dot_product(b, b) > 0),
    sm AS (SELECT project_id, asset_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY project_id, asset_id ORDER BY n DESC, key) AS place FROM co) WHERE place = 1)"""


@query("boundaries_semantic", f"""WITH {_BOUND}, {_CONTEXT},
    zz AS (SELECT z.*, CASE WHEN sim IS NULL THEN 0 ELSE 0.34{_S} END AS w7, CASE WHEN sim IS NULL THEN 0 WHEN sim <= 0.58{_S} THEN 0.34{_S} WHEN sim >= 0.88{_S} THEN -0.34{_S} * (sim - 0.88{_S}) / (1.0{_S} - 0.88{_S}) ELSE 0.34{_S} * (0.88{_S} - sim) / (0.88{_S} - 0.58{_S}) END AS n7
        FROM z LEFT JOIN sm ON sm.project_id = z.project_id AND sm.asset_id = z.asset_id),
    s7 AS (SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 AS w, n1 + n2 + n3 + n4 + n5 + n6 + n7 AS n FROM zz), c7 AS (SELECT *, CASE WHEN w > 0 THEN least(1.0{_S}, greatest(0.0{_S}, n / w)) END AS sc7 FROM s7)
    SELECT project_id, p_asset_id AS left_asset_id, asset_id AS right_asset_id, round(sc7, 6) AS score, CASE WHEN sc7 IS NULL THEN 'insufficient' WHEN sc7 >= 0.60{_S} THEN 'strong' WHEN sc7 >= 0.32{_S} THEN 'moderate' ELSE 'continuous' END AS category FROM c7""")
def boundaries_semantic(spark, sf):
    """All signals, with the context centroids of the vectors of every key."""
    return _bounds(spark, sf, None, True)[1].withColumn("score", F.round("score", 6))


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(*_bounds(spark, sf))


@query("segments", f"WITH {_SEGMENT} SELECT project_id, asset_id, segment FROM sg")
def segments(spark, sf):
    """The segment of every timed asset."""
    return _segmented(spark, sf).select("project_id", "asset_id", "segment")


@query("segment_summary", f"WITH {_SEGMENT} SELECT project_id, segment, count(*) AS n_assets, min(captured_at_unix_ms) AS start_ms, max(captured_at_unix_ms) AS end_ms, count(*) FILTER (decision = 'keep') AS n_keep, count(*) FILTER (decision = 'reject') AS n_reject, count(*) FILTER (decision IS NULL) AS n_unreviewed, count(*) FILTER (starred) AS n_starred FROM sg GROUP BY project_id, segment")
def segment_summary(spark, sf):
    """Counters of each segment."""
    return T.segment_summary(_segmented(spark, sf))


@query("representatives", f"""WITH {_SEGMENT}, f AS (SELECT *, CASE WHEN technical_score IS NOT NULL AND NOT isnan(technical_score) THEN greatest(0.0{_S}, least(1.0{_S}, technical_score{_S})) END AS te, CASE decision WHEN 'keep' THEN 1.0{_S} WHEN 'review' THEN 0.45{_S} WHEN 'reject' THEN 0.0{_S} END AS hu FROM sg),
    s AS (SELECT *, CASE WHEN te IS NOT NULL OR hu IS NOT NULL THEN (coalesce(te * 0.30{_S}, 0) + coalesce(hu * 0.25{_S}, 0)) / (CASE WHEN te IS NOT NULL THEN 0.30{_S} ELSE 0 END + CASE WHEN hu IS NOT NULL THEN 0.25{_S} ELSE 0 END) END AS score FROM f)
    SELECT project_id, segment, asset_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project_id, segment ORDER BY round(coalesce(score, 0), 9) DESC, captured_at_unix_ms, asset_id) AS r FROM s) WHERE r = 1""")
def representatives(spark, sf):
    """The best frame of each segment by technical score and decision."""
    return T.representatives(_segmented(spark, sf)).withColumn("score", F.round("score", 6))


@query("clock_offset", f"""
    WITH m AS (SELECT DISTINCT project_id, trim(camera_model) AS cam, captured_at_unix_ms AS t, trim(s) AS set_id FROM (SELECT *, unnest(similar_set_ids) AS s FROM {ASSETS} WHERE captured_at_unix_ms IS NOT NULL AND trim(camera_model) <> '') WHERE trim(s) <> ''),
    l AS (SELECT *, lag(cam) OVER w AS p_cam, lag(t) OVER w AS p_t FROM m WINDOW w AS (PARTITION BY project_id, set_id ORDER BY t, cam)),
    p AS (SELECT project_id, set_id, least(cam, p_cam) AS camera_a, greatest(cam, p_cam) AS camera_b, CASE WHEN p_cam < cam THEN p_t ELSE t END AS ta, CASE WHEN p_cam < cam THEN t ELSE p_t END AS tb FROM l WHERE p_cam <> cam),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, set_id ORDER BY abs(ta - tb), camera_a, camera_b, ta, tb) AS r FROM p) WHERE r = 1),
    o AS (SELECT project_id, camera_a, camera_b, tb - ta AS off FROM n), md AS (SELECT project_id, camera_a, camera_b, trunc(median(off))::BIGINT AS median_ms, count(*) AS n_sets FROM o GROUP BY ALL)
    SELECT project_id, camera_a, camera_b, median_ms, floor(median(abs(off - median_ms)))::BIGINT AS mad_ms, n_sets FROM o JOIN md USING (project_id, camera_a, camera_b) GROUP BY project_id, camera_a, camera_b, median_ms, n_sets HAVING n_sets >= 3 AND abs(median_ms) >= 60000 AND max(abs(off - median_ms)) <= 15000""")
def clock_offset(spark, sf):
    """Cameras of a project whose clocks differ steadily."""
    return T.clock_offsets(assets(spark, sf))


@query("partition_metrics", f"""WITH {_SEGMENT}, c AS (SELECT project_id || '/' || segment AS p, project_id || '/' || coalesce(floor(captured_at_unix_ms / 86400000.0)::BIGINT, 0) AS d, count(*) AS n FROM sg GROUP BY 1, 2)
    SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY p))::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE, 6) AS purity, (SELECT sum(k)::BIGINT FROM (SELECT count(*) - 1 AS k FROM c GROUP BY p)) AS under_segmentation, (SELECT sum(k)::BIGINT FROM (SELECT count(*) - 1 AS k FROM c GROUP BY d)) AS over_segmentation""")
def partition_metrics(spark, sf):
    """Segments against calendar days."""
    rows = _segmented(spark, sf).select(F.concat_ws("/", "project_id", F.col("segment").cast("string")).alias("p"), F.concat_ws("/", "project_id", X.bucket("captured_at_unix_ms", 86_400_000).cast("string")).alias("d"))
    return metrics.partition_metrics(rows, "p", "d").withColumn("purity", F.round("purity", 6))


@query("boundary_metrics", f"""WITH {_BOUND}, tr AS (SELECT project_id, asset_id FROM (SELECT project_id, asset_id, floor(captured_at_unix_ms / 86400000.0) AS d, lag(floor(captured_at_unix_ms / 86400000.0)) OVER w AS p FROM t {_W}) WHERE p <> d),
    pr AS (SELECT project_id, right_asset_id AS asset_id FROM bo WHERE category IN ('moderate', 'strong')), j AS (SELECT count(*) FILTER (p.asset_id IS NOT NULL AND r.asset_id IS NOT NULL) AS tp, count(*) FILTER (r.asset_id IS NULL) AS fp, count(*) FILTER (p.asset_id IS NULL) AS fn FROM pr p FULL OUTER JOIN tr r ON p.project_id = r.project_id AND p.asset_id = r.asset_id)
    SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1 FROM j""")
def boundary_metrics(spark, sf):
    """Found boundaries against changes of the day."""
    line, found = _bounds(spark, sf)
    day = T.neighbours(line.withColumn("day", X.bucket("captured_at_unix_ms", 86_400_000)), "project_id", T.ORDER, ["day"]).where("prev_day != day").select("project_id", "asset_id")
    got = metrics.boundary_metrics(found.where("category in ('moderate', 'strong')").select("project_id", F.col("right_asset_id").alias("asset_id")), day, ["project_id", "asset_id"])
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# vectors ---------------------------------------------------------------------


def _first(spark: SparkSession, sf: str) -> list[float]:
    return list(load(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


@query("knn_exact", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_exact(spark, sf):
    """The ten nearest of one vector (top-k is the feature)."""
    return V.knn_exact(load(spark, sf, "embeddings"), _first(spark, sf)).withColumn("score", F.round("score", 6))


@query("knn_hybrid", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_hybrid(spark, sf):
    """The ten nearest with one label."""
    return V.knn_exact(load(spark, sf, "embeddings"), _first(spark, sf), where=F.col("label") == 3).withColumn("score", F.round("score", 6))


def _nearest_sql(where: str) -> str:
    return f"""SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS r
    FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {where})) WHERE r <= 10"""


@query("knn_exact_many", _nearest_sql("true"))
def knn_exact_many(spark, sf):
    """The ten nearest of every 50th vector, queries in blocks against all rows."""
    e = load(spark, sf, "embeddings")
    return V.knn_many(e, _asked(e)).withColumn("score", F.round("score", 6))


@query("knn_hybrid_many", _nearest_sql("e.label = 3"))
def knn_hybrid_many(spark, sf):
    """Of every 50th vector the ten nearest with one label."""
    e = load(spark, sf, "embeddings")
    return V.knn_many(e, _asked(e), where=F.col("label") == 3).withColumn("score", F.round("score", 6))


@query("lsh_signatures", """WITH pl AS (SELECT t, b, list(CASE WHEN ('0x' || substr(md5(t || ':' || b || ':' || d), 1, 2))::INT & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS v
        FROM (SELECT unnest(range(4)) AS t), (SELECT unnest(range(16)) AS b), (SELECT unnest(range(64)) AS d) GROUP BY 1, 2)
    SELECT vec_id, t::INT AS "table", sum(CASE WHEN list_dot_product(embedding::DOUBLE[], v) >= 0 THEN 1 << b::INT ELSE 0 END)::INT AS signature FROM embeddings, pl WHERE len(embedding) = 64 GROUP BY 1, 2""")
def lsh_signatures(spark, sf):
    """The bucket table of all vectors."""
    return V.with_signatures(load(spark, sf, "embeddings"), 64)


# The exact search: what the operator gives for tables of up to 4,096 vectors.
@query("lsh_probe", _nearest_sql("true"))
def lsh_probe(spark, sf):
    """The ten nearest of every 50th vector: exact up to 4,096 vectors, else from its buckets and their one-bit neighbours."""
    e = load(spark, sf, "embeddings")
    return V.knn_lsh_many(e, V.with_signatures(e, 64), _asked(e), 64).withColumn("score", F.round("score", 6))


_CENT = """p AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    c0 AS (SELECT label, list(m ORDER BY i) AS v, max(n) AS n FROM p GROUP BY 1), c AS (SELECT label, n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c0)"""


@query("centroids_by_label", f"WITH {_CENT} SELECT label, n, array_to_string(list_transform(v, lambda x: printf('%.4f', x)), ',') AS centroid FROM c")
def centroids_by_label(spark, sf):
    """Centroids of the labels (their values as text)."""
    c = V.centroids(load(spark, sf, "embeddings"), "label")
    return c.select("label", "n", F.array_join(F.transform("centroid", lambda x: F.format_string("%.4f", x)), ",").alias("centroid"))


@query("label_top1_margin", f"""WITH {_CENT}, s AS (SELECT e.vec_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS sim FROM embeddings e, c),
    r AS (SELECT *, row_number() OVER w AS r, lead(sim) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, label)) SELECT vec_id, label, round(sim, 6) AS similarity, round(second, 6) AS second, sim >= 0.32::DOUBLE AND (second IS NULL OR sim - second >= 0.06::DOUBLE) AS accepted FROM r WHERE r = 1""")
def label_top1_margin(spark, sf):
    """Each vector's nearest label centroid with its lead."""
    e = load(spark, sf, "embeddings")
    c = cut(V.centroids(e, "label").select("label", F.col("centroid").alias("vector")))
    got = V.label_candidates(e.select("vec_id", F.col("embedding").alias("vector")), c, "vec_id", "label")
    return got.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), F.round("second", 6).alias("second"), "accepted")


@query("dominant_key", "SELECT asset_id, compatibility_key, n FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, compatibility_key) AS r FROM (SELECT asset_id, compatibility_key, count(*) AS n FROM semantic_vector GROUP BY 1, 2)) WHERE r = 1")
def dominant_key(spark, sf):
    """Each asset's most frequent vector key."""
    return V.dominant_key(load(spark, sf, "semantic_vector"), "asset_id", "compatibility_key")


@query("concept_labels", f"""WITH {_CENT}, s AS (SELECT e.vec_id AS segment, c.label, list_dot_product(e.embedding::DOUBLE[], c.v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS sim FROM embeddings e, c),
    n AS (SELECT segment, ['indoor','outdoor','close-up','wide','one person','multiple people','group','boat','water','subject'][label % 10 + 1] AS concept, max(sim) AS sim FROM s WHERE sim >= 0.32::DOUBLE GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN concept IN ('indoor','outdoor') THEN 'place' WHEN concept IN ('close-up','wide') THEN 'framing' WHEN concept IN ('one person','multiple people','group') THEN 'people' ELSE '=' || concept END AS cs FROM n),
    r AS (SELECT *, row_number() OVER w AS r, lead(sim) OVER w AS second FROM k WINDOW w AS (PARTITION BY segment, cs ORDER BY sim DESC, concept)), f AS (SELECT segment, concept, sim, row_number() OVER (PARTITION BY segment ORDER BY sim DESC, concept) AS place FROM r WHERE r = 1 AND (second IS NULL OR sim - second >= 0.06::DOUBLE))
    SELECT segment, concept, round(sim, 6) AS similarity, place FROM f WHERE place <= 3""")
def concept_labels(spark, sf):
    """conflict-free concepts of each vector, from its similarity to the label centroids."""
    e = load(spark, sf, "embeddings")
    c = cut(V.centroids(e, "label").select("label", F.col("centroid").alias("w")))
    names = F.array(*map(F.lit, ("indoor", "outdoor", "close-up", "wide", "one person", "multiple people", "group", "boat", "water", "subject")))
    left, right = e.select(F.col("vec_id").alias("segment"), "embedding", F.size("embedding").alias("d")), c.select("label", "w", F.size("w").alias("d"))
    scores = left.join(few_or_merged(right), "d").select("segment", F.get(names, F.col("label") % 10).alias("concept"), X.cosine("embedding", "w").alias("similarity"))
    best = scores.groupBy("segment", "concept").agg(F.max("similarity").alias("similarity"))
    return V.resolve_concepts(best).select("segment", "concept", F.round("similarity", 6).alias("similarity"), F.col("place").cast("bigint").alias("place"))


@query("retrieval_metrics", f"""WITH {_CENT}, s AS (SELECT e.vec_id AS query_id, e.label AS own, c.label, list_dot_product(e.embedding::DOUBLE[], c.v) AS sim FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) AS rank FROM s),
    f AS (SELECT query_id, min(CASE WHEN own = label THEN rank END) AS k FROM r GROUP BY 1) SELECT count(*) AS n_queries, round(avg(coalesce((k <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((k <= 5)::INT, 0)), 6) AS recall_at_5, round(avg(coalesce((k <= 10)::INT, 0)), 6) AS recall_at_10,
    round(avg(CASE WHEN k <= 10 THEN 1.0::DOUBLE / k ELSE 0 END), 6) AS mrr_at_10, round(avg(CASE WHEN k <= 10 THEN 1.0::DOUBLE / log2(k + 1) ELSE 0 END), 6) AS ndcg_at_10 FROM f""")
def retrieval_metrics(spark, sf):
    """How well label centroids retrieve each vector's own label."""
    from pyspark.sql import Window as W

    e = load(spark, sf, "embeddings")
    c = cut(V.centroids(e, "label").select(F.col("label").alias("other"), F.col("centroid").alias("w")))
    left, right = e.select(F.col("vec_id").alias("query_id"), "label", "embedding", F.size("embedding").alias("d")), c.select("other", "w", F.size("w").alias("d"))
    s = left.join(few_or_merged(right), "d").select("query_id", (F.col("label") == F.col("other")).alias("relevant"), "other", X.dot("embedding", "w").alias("sim"))
    hits = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "other")))
    got = metrics.retrieval_metrics(hits)
    return got.select("n_queries", *[F.round(x, 6).alias(x) for x in got.columns[1:]])


# evaluation and preferences ----------------------------------------------------

_OBS = f"(SELECT asset_id, project_id, decision, CASE decision WHEN 'keep' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS label, technical_score::DOUBLE AS s, anonymous_face_count::DOUBLE AS f FROM {ASSETS} WHERE decision IN ('keep', 'review', 'reject'))"
_PRED = f"(SELECT *, CASE WHEN s >= 0.7::DOUBLE THEN 'keep' WHEN s >= 0.5::DOUBLE THEN 'review' ELSE 'reject' END AS predicted, coalesce(s, 0) AS confidence FROM {_OBS})"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed assets as rows of features with their label."""
    a = assets(spark, sf).where(F.col("decision").isin(list(P.CLASSES)))
    s = F.col("technical_score").cast("double")
    feats = P.feature_vector([s, F.least(F.col("anonymous_face_count") / 10.0, F.lit(1.0)), F.least(F.size("similar_set_ids") / 64.0, F.lit(1.0)), F.col("rating") / 5.0], (F.col("orientation"), ("landscape", "portrait", "square")), [F.col("starred")])
    label = F.when(F.col("decision") == "keep", 0).when(F.col("decision") == "review", 1).otherwise(2)
    return a.select("asset_id", "project_id", F.col("decision").alias("actual"), label.alias("label"), s.alias("score"), feats.alias("features"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    p = F.when(s >= 0.7, "keep").when(s >= 0.5, "review").otherwise("reject")
    return observations(spark, sf).withColumns({"predicted": p, "confidence": F.coalesce(s, F.lit(0.0))})


@query("metrics_confusion", f"SELECT decision AS actual, count(*) FILTER (predicted = 'keep') AS keep, count(*) FILTER (predicted = 'review') AS review, count(*) FILTER (predicted = 'reject') AS reject FROM {_PRED} GROUP BY 1")
def metrics_confusion(spark, sf):
    """Decisions against a score rule."""
    return metrics.confusion(_predicted(spark, sf))


@query("metrics_classification", f"""WITH x AS (SELECT * FROM {_PRED}), k AS (SELECT unnest(['keep', 'review', 'reject']) AS c), f AS (SELECT c, count(*) FILTER (decision = c AND predicted = c) AS tp, count(*) FILTER (decision = c) + count(*) FILTER (predicted = c) AS s FROM x, k GROUP BY c)
    SELECT (SELECT count(*) FROM x) AS n, round((SELECT avg((decision = predicted)::INT) FROM x), 6) AS accuracy, round(avg(CASE WHEN s > 0 THEN 2.0::DOUBLE * tp / s ELSE 0 END), 6) AS macro_f1 FROM f""")
def metrics_classification(spark, sf):
    """Accuracy and macro F1 of the rule."""
    return metrics.classification(_predicted(spark, sf)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("metrics_ece", f"WITH b AS (SELECT floor(least(confidence, 0.999999::DOUBLE) * 10) AS b, count(*) AS n, avg(confidence) AS c, avg((decision = predicted)::INT) AS a FROM {_PRED} GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 6) AS ece FROM b")
def metrics_ece(spark, sf):
    """Calibration of the rule's confidence."""
    return metrics.calibration_error(_predicted(spark, sf).withColumn("correct", F.col("actual") == F.col("predicted"))).select(F.round("ece", 6).alias("ece"))


@query("latency_by_type", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(sum(value), 3) AS total, max(CASE WHEN i = floor(n / 2.0) THEN value END) AS median, max(CASE WHEN i = floor((n - 1) * 95 / 100.0) THEN value END) AS p95, max(value) AS largest FROM r GROUP BY event_type")
def latency_by_type(spark, sf):
    """The latency summary of a measurement by group."""
    return metrics.latency(load(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 3))


@query("class_support", f"SELECT k.class, k.label, count(o.asset_id) AS n_rows, count(DISTINCT o.project_id) AS n_projects FROM (SELECT unnest(['keep', 'review', 'reject']) AS class, unnest([0, 1, 2]) AS label) k LEFT JOIN {_OBS} o ON o.label = k.label GROUP BY 1, 2")
def class_support(spark, sf):
    """A10: rows and projects of each class, always three rows."""
    return P.class_support(observations(spark, sf))


@query("feature_normalizer", f"SELECT count(*) AS n, round(avg(CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) END), 6) AS mean_score, round(greatest(stddev_pop(CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) END), 0.05::DOUBLE), 6) AS scale_score, round(avg((s IS NOT NULL)::INT), 6) AS available FROM {_OBS}")
def feature_normalizer(spark, sf):
    """Centre and scale of the first feature and its availability."""
    rows = observations(spark, sf).select("features", F.get("features", F.lit(0)).alias("x"), F.get("features", F.lit(1)).alias("on"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_score"), F.round(F.greatest(F.stddev_pop("x"), F.lit(0.05)), 6).alias("scale_score"), F.round(F.avg("on"), 6).alias("available"))


@query("holdout_split", f"""WITH o AS (SELECT * FROM {_OBS}), g AS (SELECT DISTINCT 'p:' || project_id AS g, project_id FROM o WHERE project_id IS NOT NULL), n AS (SELECT count(*) AS n FROM g),
    h AS (SELECT project_id, row_number() OVER (ORDER BY md5(g), g) AS r FROM g) SELECT o.asset_id, CASE WHEN h.r <= (SELECT least(greatest(round_even(n * 0.2::DOUBLE, 0), 1), n - 1) FROM n) THEN 'validation' ELSE 'train' END AS split FROM o JOIN h USING (project_id)""")
def holdout_split(spark, sf):
    """Whole projects held out by a stable hash."""
    return P.split_groups(observations(spark, sf)).select("asset_id", "split")


FIXED = P.Model(mean=[0.6, 1.0], scale=[0.2, 0.5], weights=[[1.2, 0.1], [0.1, 0.0], [-1.3, -0.1]], biases=[0.1, 0.0, -0.1], temperature=0.9)


@query("predict_abstain", f"""WITH z AS (SELECT asset_id, (CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) END - 0.6::DOUBLE) / 0.2::DOUBLE AS x, ((s IS NOT NULL)::INT - 1.0::DOUBLE) / 0.5::DOUBLE AS y FROM {_OBS}),
    e AS (SELECT asset_id, exp((1.2::DOUBLE * x + 0.1::DOUBLE * y + 0.1::DOUBLE) / 0.9::DOUBLE) AS a, exp((0.1::DOUBLE * x) / 0.9::DOUBLE) AS b, exp((-1.3::DOUBLE * x - 0.1::DOUBLE * y - 0.1::DOUBLE) / 0.9::DOUBLE) AS c FROM z),
    p AS (SELECT asset_id, a / (a + b + c) AS k, b / (a + b + c) AS v, c / (a + b + c) AS r FROM e), t AS (SELECT *, greatest(k, v, r) AS top, greatest(k, v, r) - list_sort([k, v, r], 'DESC')[2] AS margin FROM p)
    SELECT asset_id, CASE WHEN k = top THEN 'keep' WHEN v = top THEN 'review' ELSE 'reject' END AS decision, CASE WHEN top >= 0.78::DOUBLE AND margin >= 0.15::DOUBLE THEN 'high' WHEN top >= 0.60::DOUBLE AND margin >= 0.10::DOUBLE THEN 'moderate' WHEN top >= 0.50::DOUBLE AND margin >= 0.05::DOUBLE THEN 'low' ELSE 'abstain' END AS strength, round(top, 6) AS top FROM t""")
def predict_abstain(spark, sf):
    """Predictions of fixed weights, abstaining where unsure."""
    rows = observations(spark, sf).select("asset_id", F.slice("features", 1, 2).alias("features"))
    return P.decide(P.with_probabilities(rows, FIXED)).select("asset_id", "decision", "strength", F.round("top", 6).alias("top"))


@query("metrics_probability", f"""WITH z AS (SELECT label, (CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) END - 0.6::DOUBLE) / 0.2::DOUBLE AS x, ((s IS NOT NULL)::INT - 1.0::DOUBLE) / 0.5::DOUBLE AS y FROM {_OBS}),
    e AS (SELECT label, exp((1.2::DOUBLE * x + 0.1::DOUBLE * y + 0.1::DOUBLE) / 0.9::DOUBLE) AS a, exp((0.1::DOUBLE * x) / 0.9::DOUBLE) AS b, exp((-1.3::DOUBLE * x - 0.1::DOUBLE * y - 0.1::DOUBLE) / 0.9::DOUBLE) AS c FROM z), p AS (SELECT label, [a, b, c] AS e, a + b + c AS t FROM e)
    SELECT round(avg(-ln(greatest(e[label + 1] / t, 1e-7::DOUBLE))), 6) AS log_loss, round(avg(((e[1] / t - (label = 0)::INT) ** 2 + (e[2] / t - (label = 1)::INT) ** 2 + (e[3] / t - (label = 2)::INT) ** 2) / 3), 6) AS brier FROM p""")
def metrics_probability(spark, sf):
    """Log-loss and Brier score of fixed weights."""
    rows = observations(spark, sf).select("label", F.slice("features", 1, 2).alias("features"))
    return metrics.probability_scores(P.with_probabilities(rows, FIXED)).select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("softmax_fit")
def softmax_fit(spark, sf):
    """Fit on the training projects, calibrate and evaluate on the held-out ones."""
    rows = cut(P.split_groups(observations(spark, sf)))
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    model = P.fit_softmax(train)
    model.temperature = P.select_temperature(held, model)
    said = cut(P.decide(P.with_probabilities(held, model)).withColumnRenamed("decision", "predicted"))
    m = metrics.classification(said).first()
    state = P.readiness(rows, {"validation_rows": m["n"], "macro_f1": m["macro_f1"]}).first()["state"]
    return said.select("asset_id", "actual", "predicted", "strength", F.round("top", 6).alias("top"), F.lit(model.temperature).alias("temperature"), F.lit(state).alias("state"))


@query("pairwise_fit")
def pairwise_fit(spark, sf):
    """Weights from human choices, and each set's members ranked by them."""
    from pyspark.sql import Window as W

    obs = cut(observations(spark, sf).select("asset_id", "features"))
    model = P.fit_softmax(observations(spark, sf), P.TrainingConfig(steps=1))
    pref = load(spark, sf, "pairwise_preference").where("training_eligible and chosen_asset_id != alternative_asset_id").dropDuplicates(["preference_id"])
    pairs = pref.join(obs.select(F.col("asset_id").alias("chosen_asset_id"), F.col("features").alias("chosen_features")), "chosen_asset_id").join(obs.select(F.col("asset_id").alias("alternative_asset_id"), F.col("features").alias("other_features")), "alternative_asset_id")
    w = P.fit_pairwise(pairs, model) or [0.0] * len(model.scale)
    score = F.aggregate(F.zip_with("features", F.array(*[F.lit(a / s) for a, s in zip(w, model.scale)]), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    members = pref.select("similarity_set_id", F.explode(F.array("chosen_asset_id", "alternative_asset_id")).alias("asset_id")).distinct().join(obs, "asset_id").withColumn("score", F.round(score, 6))
    return members.select("similarity_set_id", "asset_id", "score", F.row_number().over(W.partitionBy("similarity_set_id").orderBy(F.desc("score"), "asset_id")).alias("place"))


# incremental -------------------------------------------------------------------

_SPLIT_MS = 1_690_000_000_000


@query("tail_incremental", f"""WITH o AS (SELECT * FROM {ASSETS} WHERE epoch_ms(ingested_at) < {_SPLIT_MS}), n AS (SELECT * FROM {ASSETS} WHERE epoch_ms(ingested_at) >= {_SPLIT_MS} AND project_id IS NOT NULL), tl AS (SELECT project_id, max(captured_at_unix_ms) AS tail FROM o GROUP BY 1),
    g AS (SELECT project_id, count(*) AS n_new, min(captured_at_unix_ms) AS f, count(captured_at_unix_ms) AS d FROM n GROUP BY 1) SELECT g.project_id, n_new, CASE WHEN d = 0 THEN 'undated_only' WHEN tail IS NULL OR f > tail THEN 'tail' ELSE 'rebuild' END AS disposition FROM g LEFT JOIN tl USING (project_id)""")
def tail_incremental(spark, sf):
    """What the rows ingested from a date on ask of each project's timeline."""
    from ..streaming.replay import classify_append

    a = assets(spark, sf).where("project_id is not null")
    return classify_append(a.where(F.unix_millis("ingested_at") < _SPLIT_MS), a.where(F.unix_millis("ingested_at") >= _SPLIT_MS))


_VALUES = "project_id capture_device_id captured_at_unix_ms camera_model lens_model orientation anonymous_face_count similar_set_ids filename_sequence technical_score decision rating starred".split()
_BEFORE = ASSETS.replace("WHERE asset_id IS NOT NULL", f"WHERE asset_id IS NOT NULL AND epoch_ms(ingested_at) < {_SPLIT_MS}")
_SINCE = ASSETS.replace("WHERE asset_id IS NOT NULL", f"WHERE asset_id IS NOT NULL AND epoch_ms(ingested_at) >= {_SPLIT_MS}")


@query("append_raw", f"""WITH e AS (SELECT * FROM {_BEFORE} WHERE project_id IS NOT NULL), b AS (SELECT * FROM {_SINCE} WHERE project_id IS NOT NULL), tl AS (SELECT project_id AS p, max(captured_at_unix_ms) AS tail FROM e GROUP BY 1),
    s AS (SELECT b.project_id AS bp, b.captured_at_unix_ms AS bt, e.project_id AS ep, e.captured_at_unix_ms AS et FROM b LEFT JOIN e ON e.asset_id = b.asset_id WHERE e.asset_id IS NULL OR {' OR '.join(f'b.{v} IS DISTINCT FROM e.{v}' for v in _VALUES)}),
    u AS (SELECT bp AS p, bt AS t, 1 AS one FROM s UNION ALL SELECT ep, et, 0 FROM s WHERE et IS NOT NULL), a AS (SELECT p, sum(one)::BIGINT AS n_new, min(t) AS f, count(t) AS d FROM u GROUP BY 1), w AS (SELECT project_id AS p FROM b UNION SELECT p FROM u WHERE one = 0)
    SELECT w.p AS project_id, coalesce(n_new, 0) AS n_new, CASE WHEN d IS NULL THEN 'no_change' WHEN d = 0 THEN 'undated_only' WHEN tail IS NULL OR f > tail THEN 'tail' ELSE 'rebuild' END AS disposition FROM w LEFT JOIN a ON a.p = w.p LEFT JOIN tl ON tl.p = w.p""")
def append_raw(spark, sf):
    """What all rows delivered from a date on ask of each timeline, assets known before with other values among them."""
    from ..operators.readmodels import latest_by
    from ..streaming.replay import classify_append

    rows = load(spark, sf, "timeline_asset").where("asset_id is not null")
    late = F.unix_millis("ingested_at") >= _SPLIT_MS
    before, since = (latest_by(rows.where(x), "asset_id", ["ingested_at"]).where("project_id is not null") for x in (~late, late))
    return classify_append(before, since)


@query("changed_sets", f"""WITH t AS (SELECT * FROM {ASSETS} WHERE project_id IS NOT NULL), k AS (SELECT project_id, max(captured_at_unix_ms) AS tail FROM t WHERE epoch_ms(ingested_at) < {_SPLIT_MS} GROUP BY 1),
    m AS (SELECT t.project_id, captured_at_unix_ms AS c, tail, epoch_ms(ingested_at) >= {_SPLIT_MS} AND rating IS NOT NULL AS said FROM t LEFT JOIN k ON k.project_id = t.project_id),
    g AS (SELECT project_id, count(*) FILTER (said) AS n, count(*) FILTER (said AND c IS NOT NULL) AS dated, count(*) FILTER (c IS NOT NULL AND CASE WHEN said THEN tail IS NULL OR c <= tail ELSE c > tail END) AS bad FROM m GROUP BY 1)
    SELECT project_id, CASE WHEN n = 0 THEN 'no_change' WHEN dated = 0 THEN 'undated_only' WHEN bad = 0 THEN 'tail' ELSE 'rebuild' END AS disposition FROM g""")
def changed_sets(spark, sf):
    """What a declared set of changed assets (the rated ones of a date on) asks of each timeline."""
    from ..streaming.replay import classify_changed

    a = cut(assets(spark, sf).where("project_id is not null"))
    late = F.unix_millis("ingested_at") >= _SPLIT_MS
    tails = a.where(~late).groupBy("project_id").agg(F.max("captured_at_unix_ms").alias("tail"))
    return classify_changed(a, a.where(late & F.col("rating").isNotNull()).select("asset_id"), tails)


@query("label_states", f"""WITH {_CENT}, s AS (SELECT e.vec_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS sim FROM embeddings e, c),
    r AS (SELECT *, row_number() OVER w AS r, lead(sim) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, label))
    SELECT e.vec_id, CASE WHEN e.vec_id % 4 = 0 THEN 'semantic_evidence_unavailable' WHEN e.vec_id % 4 < 2 OR NOT coalesce(sim >= 0.32::DOUBLE AND (second IS NULL OR sim - second >= 0.06::DOUBLE), false) THEN 'abstained' ELSE 'suggested' END AS state
    FROM embeddings e LEFT JOIN r ON r.vec_id = e.vec_id AND r.r = 1""")
def label_states(spark, sf):
    """P20: whether each vector's best label is suggested, with two supporting vectors as the least (none to three are given)."""
    e = load(spark, sf, "embeddings")
    c = cut(V.centroids(e, "label").select("label", F.col("centroid").alias("vector")))
    found = V.label_candidates(e.select("vec_id", F.col("embedding").alias("vector")), c, "vec_id", "label")
    return V.label_state(e.select("vec_id", (F.col("vec_id") % 4).alias("n_vectors")), found, "vec_id", 2)


@query("stream_replay", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def stream_replay(spark, sf):
    """The events as a file stream, one micro-batch each, collected by batch and rolled up."""
    from ..session import scratch_path
    from ..streaming.replay import replay_files

    src = scratch_path(spark, "replay")
    load(spark, sf, "events").repartition(3).write.parquet(f"{src}/in")
    schema = spark.read.parquet(f"{src}/in").schema.simpleString()[len("struct<") : -1]
    replay_files(spark, f"{src}/in", ", ".join(x.replace(":", " ", 1) for x in schema.split(",")), f"{src}/state", lambda df, i: df.write.mode("overwrite").parquet(f"{src}/out/batch={i}"))
    return spark.read.parquet(f"{src}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


QUERIES = Q
ORACLE = SQL
