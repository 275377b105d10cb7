"""Queries of operators that no driver table has input for: literal inputs against literal results, and whole tables where they fit.

The literal results are what the operators are specified to give, written down by
hand; they aren't derived from the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks, planner, prefs, readmodels as R, selection, vectors as V
from ..session import load
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


def _quoted(v: object) -> str:
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL for a table of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) t({columns})"


# names ------------------------------------------------------------------------

NAMES = [
    ("CON / boat?.", "CON _ boat_"), ("CON", "_CON"), ("CON.txt", "_CON.txt"), ("con.tar.gz", "_con.tar.gz"), ("COM0", "COM0"), ("lpt9", "_lpt9"), (". . a", ". a"), (" .a. ", "a"),
    ("a::b", "a_b"), ("..", "Untitled"), ("", "Untitled"), ("tab\there", "tab_here"), ("A / Test_0001.ARW", "A _ Test_0001.ARW"), ("x" * 130, "x" * 120),
]


@query("sanitize_cases", _values("i, safe", [(i, s) for i, (_, s) in enumerate(NAMES)]))
def sanitize_cases(spark: SparkSession, sf: str) -> DataFrame:
    """device names, dots, blanks and control characters."""
    rows = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(NAMES)], "i int, written string")
    return rows.select("i", X.sanitize_component("written").alias("safe"))


FILES = [
    ("DSC_1.ARW", "raw"), ("a.3fr", "raw"), ("a.pef", "raw"), ("a.srw", "raw"), ("a.CR3", "raw"), ("a.jpg", "jpeg"), ("a.JPEG", "jpeg"), ("a.heif", "heif"), ("a.png", "png"), ("a.tiff", "tiff"), ("a.m4v", "video"),
    ("a.mkv", "unknown"), ("a.flac", "unknown"), ("a.aif", "audio"), ("a.xmp", "sidecar"), ("a.thm", "unknown"), ("a.pdf", "unknown"), ("a.bmp", "unknown"), ("arw", "unknown"), ("a.", "unknown"),
]


@query("extension_cases", _values("name, media_class", FILES))
def extension_cases(spark: SparkSession, sf: str) -> DataFrame:
    """P10: the class of a file name, whatever its case."""
    return spark.createDataFrame([(n,) for n, _ in FILES], "name string").select("name", X.media_class("name").alias("media_class"))


MOMENTS = [(None, "Boat / Portraits", 2, "03_Boat _ Portraits"), (None, None, 2, "03_Moment_003"), ("Our day", "Boat", 0, "01_Our day"), ("NUL", None, 11, "12__NUL")]


@query("moment_folders", _values("i, folder", [(i, m[3]) for i, m in enumerate(MOMENTS)]))
def moment_folders(spark: SparkSession, sf: str) -> DataFrame:
    """folders of moments by human, suggested or numbered label."""
    rows = spark.createDataFrame([(i, *m[:3]) for i, m in enumerate(MOMENTS)], "i int, human string, suggested string, ordinal int")
    return rows.select("i", X.moment_folder("human", "suggested", "ordinal").alias("folder"))


CONCEPTS = [("indoor,group", "Indoor group"), ("outdoor,boat,water", "Outdoor boat by water"), ("wide,boat", "Wide boat view"), ("close-up,one person", "Close-up portrait"), ("", None)]


@query("composed_labels", _values("i, label", [(i, c[1]) for i, c in enumerate(CONCEPTS)]))
def composed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """a label from the concepts that were kept."""
    rows = spark.createDataFrame([(i, [x for x in c[0].split(",") if x]) for i, c in enumerate(CONCEPTS)], "i int, concepts array<string>")
    return rows.select("i", V.compose_label(F.col("concepts")).alias("label"))


# search -----------------------------------------------------------------------

SEARCHES = [
    ("5 star sharp photos with 1 face near water", False, "near water", "Faces: 1|Rating: 5★|Sharpness: sharp"),
    ("two people on a yellow boat", False, "two people on a yellow boat", "Faces: 2"),
    ("find person named John", True, "", "Identity search unavailable"),
    ("find the person in red", True, "", "Identity search unavailable"),
    ("Identify the person here", True, "", "Identity search unavailable"),
    ("find yellow boat", False, "find yellow boat", ""),
    ("recognize boats", False, "recognize boats", ""),
    ("technical issue photos", False, "", "Technical quality: issue"),
    ("quality issues and blur", False, "", "Blur: review|Technical quality: issue"),
    ("rejected 3+ stars", False, "", "Rating: 3★+|Decision: Reject"),
    ("kept camera ex-1 with dogs", False, "camera ex-1 dogs", "Decision: Keep|Camera: EX-1"),
    ("seven faces", False, "seven faces", ""),
]


@query("query_plans", _values("i, blocked, text, chips", [(i, *s[1:]) for i, s in enumerate(SEARCHES)]))
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Search texts as plans; searches for a person's identity are blocked."""
    plans = [planner.plan_query(s[0]) for s in SEARCHES]
    return spark.createDataFrame([(i, p.blocked, p.text, "|".join(p.chips)) for i, p in enumerate(plans)], "i int, blocked boolean, text string, chips string")


FILTERED = ["5 stars", "4+ stars kept", "one face", "rejected blurry", "sharp review", "technical issues", "who is this"]
_CONDITIONS = [
    "rating = 5", "rating >= 4 AND decision = 'keep'", "anonymous_face_count = 1", "decision = 'reject' AND technical_score < 0.20", "technical_score >= 0.62 AND decision = 'review'", "technical_score < 0.30", "false",
]


@query("search_filters", f"WITH a AS (SELECT * REPLACE (technical_score::DOUBLE AS technical_score) FROM {ASSETS}) " + " UNION ALL ".join(f"SELECT {_quoted(t)} AS text, count(*) AS n FROM a WHERE {c}" for t, c in zip(FILTERED, _CONDITIONS)))
def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The assets that the filters of search texts keep, counted in one pass."""
    plans = {t: planner.plan_query(t) for t in FILTERED}
    a = assets(spark, sf).withColumn("technical_score", F.col("technical_score").cast("double"))
    n = a.agg(*[F.count_if(F.lit(False) if p.blocked else p.predicate()).alias(t) for t, p in plans.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(t).alias("text"), F.col(f"`{t}`").alias("n")) for t in plans])).alias("x")).select("x.*")


@query("search_sorts", f"""WITH r AS (SELECT asset_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, technical_score::DOUBLE)), 6) AS score, rating, captured_at_unix_ms AS t FROM {ASSETS} WHERE starred AND technical_score IS NOT NULL ORDER BY score DESC, asset_id LIMIT 40),
    s AS (SELECT asset_id, row_number() OVER (ORDER BY score DESC, asset_id) AS by_relevance, row_number() OVER (ORDER BY t NULLS LAST, score DESC, asset_id) AS by_time, row_number() OVER (ORDER BY rating DESC NULLS LAST, score DESC, asset_id) AS by_rating FROM r) SELECT * FROM s""")
def search_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """O3: one page of results in three orders."""
    a = assets(spark, sf)
    score = F.round(X.clamp(F.col("technical_score").cast("double")), 6)
    found = a.where("starred and technical_score is not null").select("asset_id", score.alias("score")).orderBy(F.desc("score"), "asset_id").limit(40)
    places: dict[str, dict[str, int]] = {}
    for name, sort in (("by_relevance", "relevance"), ("by_time", "captureTime"), ("by_rating", "rating")):
        for i, r in enumerate(planner.sorted_results(found, a, sort).select("asset_id").collect(), 1):  # a page
            places.setdefault(r["asset_id"], {})[name] = i
    return spark.createDataFrame([(k, v["by_relevance"], v["by_time"], v["by_rating"]) for k, v in places.items()], "asset_id string, by_relevance int, by_time int, by_rating int")


@query("page_slice", f"""WITH a AS (SELECT asset_id, rating FROM {ASSETS} WHERE rating IS NOT NULL), p AS (SELECT *, row_number() OVER (ORDER BY rating DESC, asset_id) AS place, count(*) OVER () AS n FROM a)
    SELECT asset_id, rating, place - 48 AS place, n > 72 AS has_more FROM p WHERE place > 48 AND place <= 72""")
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of a group view, and whether more follow."""
    return R.page(assets(spark, sf).where("rating is not null").select("asset_id", "rating"), [F.desc("rating"), F.col("asset_id")], "group", 2)


# filters of the views -----------------------------------------------------------

MEDIA = ["all", "photos", "video", "audio", "sidecars", "unknown", "anything else"]
_CLASS = """(SELECT CASE WHEN e IN ('arw', 'cr2', 'cr3', 'dng', 'nef', 'orf', 'raf', 'rw2', 'pef', 'srw', '3fr', 'jpg', 'jpeg', 'heic', 'heif', 'png', 'tif', 'tiff') THEN 'photos' WHEN e IN ('mov', 'mp4', 'm4v', 'avi', 'mxf') THEN 'video'
    WHEN e IN ('wav', 'mp3', 'm4a', 'aac', 'aif', 'aiff') THEN 'audio' WHEN e IN ('xmp', 'srt', 'xml', 'json') THEN 'sidecars' ELSE 'unknown' END AS c FROM (SELECT lower(regexp_extract(split_part(relative_path, '/', -1), '^.+\\.([^.]*)$', 1)) AS e FROM delivery_source))"""


@query("media_filters", " UNION ALL ".join(f"SELECT {_quoted(m)} AS filter, count(*) AS n FROM {_CLASS}" + ("" if m in ("all", "anything else") else f" WHERE c = '{m}'") for m in MEDIA))
def media_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Copies that each media filter keeps; an unknown filter keeps all."""
    rows = load(spark, sf, "delivery_source").select(X.media_class("relative_path").alias("media_class"))
    n = rows.agg(*[F.count_if(R.media_type_filter(m)).alias(m) for m in MEDIA])
    return n.select(F.explode(F.array(*[F.struct(F.lit(m).alias("filter"), F.col(f"`{m}`").alias("n")) for m in MEDIA])).alias("x")).select("x.*")


SEEN = [
    ("a", "raw", True, "strong", "exact", 2, False, "low"), ("b", "jpeg", True, "technical_issue", "burst", 0, None, "high"), ("c", "heif", False, "good", None, None, True, "uncertain"),
    ("d", "video", True, None, None, None, None, None), ("e", "audio", False, None, None, None, None, None), ("f", "png", None, "review", "near", 1, True, "moderate"),
]
VISUAL = {
    "all": "abcdef", "photos": "abcf", "raw": "a", "jpegHeif": "bc", "video": "d", "audio": "e", "offline": "ce", "available": "abd", "strongCandidates": "a", "technicalIssues": "b",
    "probableDuplicates": "af", "similarGroups": "abf", "faces": "af", "possibleClosedEyes": "cf", "blurReview": "bcf",
}


@query("visual_filters", _values("filter, kept", list(VISUAL.items())))
def visual_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen filters of the browser over rows with and without evidence."""
    rows = spark.createDataFrame(SEEN, "id string, media_class string, available boolean, quality_band string, group_kind string, face_count int, closed_eyes boolean, blur_level string")
    hits = F.array_compact(F.array(*[F.when(R.visual_filter(name), F.lit(name)) for name in VISUAL]))
    return rows.select("id", F.explode(hits).alias("filter")).groupBy("filter").agg(F.array_join(F.array_sort(F.collect_list("id")), "").alias("kept"))


# checks -------------------------------------------------------------------------

REQUESTS = [("good", [("a",), ("b",)], (0.5,), (1.0, 0.0), None), ("blank", [("a",), (" ",)], (), (), "blank id"), ("null", [("a",), (None,)], (), (), "blank id"), ("repeated", [("a",), ("a",)], (), (), "repeated id"), ("threshold", [("a",)], (1.5,), (), "thresholds lie within [0, 1]"), ("weight", [("a",)], (), (-1.0,), "weights are finite and not negative")]


@query("request_checks", _values("request, refused", [(r[0], r[4]) for r in REQUESTS]))
def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and why they are refused whole."""
    out = []
    for name, rows, thresholds, weights, _ in REQUESTS:
        try:
            checks.validate_request(spark.createDataFrame(rows, "id string"), "id", thresholds, weights)
            out.append((name, None))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "request string, refused string")


MANIFESTS = [
    ("m1", 1, list(checks.EXCLUSIONS), "a/b.jpg", None), ("m2", 1, list(checks.EXCLUSIONS), "../b.jpg", "unsafe_path"), ("m3", 2, list(checks.EXCLUSIONS), "a.jpg", "schema_version"),
    ("m4", 1, ["database_paths"], "a.jpg", "privacy_exclusion"), ("m5", None, None, "/a", "unsafe_path,schema_version,privacy_exclusion"),
]


@query("manifest_checks", _values("manifest, problems", [(m[0], m[4]) for m in MANIFESTS if m[4]]))
def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that may not be handed over, and why."""
    rows = spark.createDataFrame([m[:4] for m in MANIFESTS], "manifest string, schema_version int, exclusions array<string>, path string")
    return checks.manifest_problems(rows, "manifest")


@query("ordered_checksums", f"""WITH s AS (SELECT project_id AS p, asset_id, rating, row_number() OVER (PARTITION BY project_id ORDER BY asset_id) AS o FROM {ASSETS} WHERE project_id IS NOT NULL),
    b AS (SELECT p, floor((o - 1) / 1000.0) AS b, sha256(string_agg(asset_id || chr(31) || coalesce(rating::VARCHAR, chr(0)), chr(30) ORDER BY o)) AS d FROM s GROUP BY 1, 2)
    SELECT p AS project_id, sha256(string_agg(d, '' ORDER BY b)) AS checksum FROM b GROUP BY 1""")
def ordered_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each project's assets and ratings in the order of their ids."""
    placed = selection.sequence(assets(spark, sf).where("project_id is not null").select("project_id", "asset_id", "rating"), "project_id", ["asset_id"])
    return selection.ordered_checksum(placed, "project_id", "sequence", ["asset_id", "rating"])


BANDS = [(80.0, 1.0, 1.0, "strong"), (76.0, 4.9, 11.9, "strong"), (90.0, 5.0, 0.0, "good"), (90.0, 0.0, 12.0, "good"), (75.9, 0.0, 0.0, "good"), (54.0, 50.0, 50.0, "good"), (53.9, 0.0, 0.0, "review"), (30.0, 0.0, 0.0, "review"), (29.9, 0.0, 0.0, "technical_issue"), (None, 0.0, 0.0, None)]


@query("band_cases", _values("i, band", [(i, b[3]) for i, b in enumerate(BANDS)]))
def band_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of scores with clipped highlights and shadows."""
    rows = spark.createDataFrame([(i, *b[:3]) for i, b in enumerate(BANDS)], "i int, score double, highlights double, shadows double")
    return rows.select("i", X.quality_band("score", "highlights", "shadows").alias("band"))


# features and helpers -----------------------------------------------------------


@query("one_hot_features", f"""SELECT round(sum(CASE WHEN technical_score IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, technical_score::DOUBLE)) END), 3) AS unit, count(technical_score) AS available, count(*) FILTER (decision = 'keep') AS keep,
    count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision IS NULL OR decision NOT IN ('keep', 'review')) AS none, count(*) FILTER (starred) AS starred FROM {ASSETS}""")
def one_hot_features(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the columns of a feature vector with a one-hot code and a flag."""
    v = assets(spark, sf).select(prefs.feature_vector([F.col("technical_score")], (F.col("decision"), ("keep", "review")), [F.col("starred")]).alias("v"))
    names = ("unit", "available", "keep", "review", "none", "starred")
    return v.agg(*[(F.round(F.sum(F.get("v", F.lit(i))), 3) if n == "unit" else F.sum(F.get("v", F.lit(i))).cast("bigint")).alias(n) for i, n in enumerate(names)])


@query("clamped", "SELECT l_orderkey, l_linenumber, round(sum(greatest(0.2::DOUBLE, least(0.9::DOUBLE, l_discount * 10))), 6) AS bounded FROM lineitem GROUP BY ALL")
def clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Values within bounds."""
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(X.clamp(F.col("l_discount") * 10, 0.2, 0.9)), 6).alias("bounded"))


@query("distinct_evidence", "SELECT DISTINCT project_id, lower(perceptual_hash) AS hash FROM fingerprint_evidence")
def distinct_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each hash once in a project."""
    return load(spark, sf, "fingerprint_evidence").select("project_id", F.lower("perceptual_hash").alias("hash")).distinct()


WEIGHTED = prefs.Model(mean=[0.5, 0.0, 0.2], scale=[0.5, 1.0, 0.1], weights=[[1.0, -2.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]], biases=[0.0, 0.0, 0.0], temperature=1.0)


@query("top_contributions", _values("id, first, size", [("a", "y", -2.0), ("b", "x", 1.0), ("c", None, None)]))
def top_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """The feature that speaks loudest for or against a class; none where all are silent."""
    rows = spark.createDataFrame([("a", [1.0, 1.0, 0.9]), ("b", [1.0, 0.25, 0.9]), ("c", [0.5, 0.0, 0.9])], "id string, features array<double>")
    told = prefs.contributions(rows, WEIGHTED, ["x", "y", "z"], 0)
    return told.select("id", F.get("explanations", F.lit(0))["name"].alias("first"), F.round(F.get("explanations", F.lit(0))["contribution"], 6).alias("size"))


QUERIES = Q
ORACLE = SQL
