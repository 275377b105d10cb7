"""Timeline analysis: cadence, boundaries, segments, representatives, gaps, clocks.

All per-project orders run over range-sorted chunks with a halo, so that a large
project is spread over many tasks; missing evidence leaves both sides of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clamp, cosine, normalize, valid_vector
from .ordered import neighbours, running_sum, sliced, with_halo


@dataclass(frozen=True)
class TimelineConfig:
    time_gap: float = 0.36
    semantic: float = 0.34
    camera_lens: float = 0.10
    orientation: float = 0.06
    faces: float = 0.04
    similar_sets: float = 0.08
    filename: float = 0.02
    moderate: float = 0.32
    strong: float = 0.60
    semantic_boundary: float = 0.58
    semantic_continuity: float = 0.88
    filename_gap: int = 12
    context: int = 4
    cadence_samples: int = 3
    centrality: float = 0.45
    technical: float = 0.30
    human: float = 0.25


ORDER = ["captured_at_unix_ms", "asset_id"]


def timeline(assets: DataFrame, columns: list[str]) -> DataFrame:
    """The timed assets of every project in ordered chunks (project, time, id)."""
    timed = assets.where("project_id is not null and asset_id is not null and captured_at_unix_ms is not null")
    return sliced(timed.select("project_id", "captured_at_unix_ms", "asset_id", *columns), "project_id", ORDER)


def gaps(chunked: DataFrame, columns: list[str] = ()) -> DataFrame:
    """``gap_ms`` between neighbours; of the left one its time, id and ``columns`` with ``prev_`` before their names."""
    return neighbours(chunked, "project_id", ORDER, ["captured_at_unix_ms", "asset_id", *columns]).where("prev_asset_id is not null").withColumn("gap_ms", F.col("captured_at_unix_ms") - F.col("prev_captured_at_unix_ms"))


def nearest_rank(values: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group from counts of distinct values: exact, without one task per group.

    Values are counted first; their running counts are taken over ordered chunks.
    """
    counted = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(sliced(counted, group, [value]), group, [value], F.col("_n"), "_upto")
    total = counted.groupBy(group).agg(F.sum("_n").alias("n_samples"))
    hit = upto.join(total, group)
    return hit.groupBy(group).agg(F.max("n_samples").alias("n_samples"), *[F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("n_samples") * F.lit(s)), F.lit(1)), F.col(value))).alias(name) for name, s in shares.items()])


def cadence(gapped: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """Positive gaps of each project: samples, median, p90 and the normalizer; null where there are too few."""
    p = nearest_rank(gapped.where("gap_ms > 0"), "project_id", "gap_ms", {"median_gap_ms": 0.5, "p90_gap_ms": 0.9})
    enough = F.col("n_samples") >= config.cadence_samples
    norm = F.greatest(F.col("p90_gap_ms"), F.col("median_gap_ms") * 2, F.lit(1))
    return p.select("project_id", F.col("n_samples").alias("positive_gap_samples"), *[F.when(enough, x).alias(n) for n, x in (("median_gap_ms", F.col("median_gap_ms")), ("p90_gap_ms", F.col("p90_gap_ms")), ("normalizer_gap_ms", norm))])


def _text(x: str) -> Column:
    t = F.lower(F.trim(F.col(x)))
    return F.when(t != "", t)


def signals(config: TimelineConfig = TimelineConfig()) -> dict[str, tuple[Column, Column]]:
    """(boundary, continuity) support of each signal, both null where it is unavailable.

    Columns of the right neighbour have plain names, of the left ``prev_`` ones;
    ``normalizer_gap_ms`` and ``semantic_similarity`` may be null.
    """
    gap = F.col("captured_at_unix_ms") - F.col("prev_captured_at_unix_ms")
    time = F.when(F.col("normalizer_gap_ms").isNotNull() & (gap >= 0), F.least(gap / F.col("normalizer_gap_ms"), F.lit(1.0)))
    sim, low, high = F.col("semantic_similarity"), config.semantic_boundary, config.semantic_continuity
    sem_b = F.when(sim <= low, 1.0).when(sim >= high, 0.0).otherwise((high - sim) / (high - low))
    sem_c = F.when(sim >= high, (sim - high) / (1.0 - high)).otherwise(0.0)
    pairs = [(_text(f"prev_{x}"), _text(x)) for x in ("camera_model", "lens_model")]
    comparable = sum(((a.isNotNull() & b.isNotNull()).cast("int") for a, b in pairs), F.lit(0))
    changed = sum((F.coalesce(a != b, F.lit(False)).cast("int") for a, b in pairs), F.lit(0))
    cam = comparable > 0
    turn = F.col("prev_orientation") == F.col("orientation")
    faces = F.abs(F.col("prev_anonymous_face_count") - F.col("anonymous_face_count"))
    clean = lambda x: F.filter(x, lambda s: F.trim(s) != "")
    shared = F.coalesce(F.arrays_overlap(clean("prev_similar_set_ids"), clean("similar_set_ids")), F.lit(False))
    seq = F.abs(F.col("prev_filename_sequence") - F.col("filename_sequence"))
    return {
        "time_gap": (time, 1.0 - time),
        "semantic": (F.when(sim.isNotNull(), sem_b), F.when(sim.isNotNull(), sem_c)),
        "camera_lens": (F.when(cam, F.when(changed == 0, 0.0).otherwise(changed / comparable)), F.when(cam, F.when(changed == 0, 0.70).otherwise(0.0))),
        "orientation": (F.when(turn, 0.0).when(~turn, 0.80), F.when(turn, 0.60).when(~turn, 0.0)),
        "faces": (F.when(faces == 0, 0.0).when(faces == 1, 0.25).when(faces == 2, 0.45).when(faces > 2, 0.60), F.when(faces == 0, 0.45).when(faces > 0, 0.0)),
        "similar_sets": (F.when(shared, 0.0), F.when(shared, 0.90)),
        "filename": (F.when(seq <= 1, 0.0).when(seq >= config.filename_gap, 0.10), F.when(seq <= 1, 0.25).when(seq >= config.filename_gap, 0.0)),
    }


def boundary_score(parts: dict[str, tuple[Column, Column]], config: TimelineConfig = TimelineConfig(), only: tuple[str, ...] | None = None) -> Column:
    """Net weighted support of the available signals, at least 0; null if none is available."""
    net, weight = F.lit(0.0), F.lit(0.0)
    for name, (b, c) in parts.items():
        if only and name not in only:
            continue
        w = getattr(config, name)
        net = net + F.when(b.isNotNull(), F.lit(w) * (b - c)).otherwise(0.0)
        weight = weight + F.when(b.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, clamp(F.greatest(net / weight, F.lit(0.0))))


def category(score: Column, config: TimelineConfig = TimelineConfig()) -> Column:
    return F.when(score.isNull(), "insufficient").when(score >= config.strong, "strong").when(score >= config.moderate, "moderate").otherwise("continuous")


COLUMNS = ["camera_model", "lens_model", "orientation", "anonymous_face_count", "similar_set_ids", "filename_sequence"]


def context_similarity(chunked: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """``project_id, asset_id, semantic_similarity`` of the vectors before and from each asset, and how many took part (``n_context``).

    ``chunked`` has ``key`` and ``vector``.  Up to ``context`` vectors on either
    side; each side stops at the first invalid vector or one of another key or
    length than the nearest on the left; null unless both sides have some.
    """
    k = config.context
    w = W.partitionBy("project_id", "chunk").orderBy(*ORDER)
    item = F.struct(F.when(valid_vector("vector"), F.col("key")).alias("key"), F.size("vector").alias("d"), F.col("vector").alias("v"))
    wide = with_halo(chunked.withColumn("item", item), "project_id", ORDER, k)
    framed = wide.withColumns({"before": F.reverse(F.collect_list("item").over(w.rowsBetween(-k, -1))), "after": F.collect_list("item").over(w.rowsBetween(0, k - 1))})
    first = F.get("before", F.lit(0))

    def prefix(items: str) -> Column:
        fits = lambda s: F.coalesce((s["key"] == first["key"]) & (s["d"] == first["d"]), F.lit(False))
        stop = F.filter(F.transform(F.col(items), lambda s, i: F.when(~fits(s), i)), lambda i: i.isNotNull())
        return F.slice(F.col(items), F.lit(1), F.coalesce(F.array_min(stop), F.size(items)).cast("int"))

    def centre(items: str) -> Column:
        vs = F.transform(prefix(items), lambda s: s["v"])
        n = F.size(vs)
        total = F.aggregate(F.slice(vs, F.lit(2), F.greatest(n - 1, F.lit(0))), F.transform(F.get(vs, F.lit(0)), lambda x: x.cast("double")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double")))
        return F.when(n > 0, normalize(total))

    out = framed.where(~F.col("halo")).withColumns({"_l": centre("before"), "_r": centre("after")})
    return out.select("project_id", "asset_id", cosine("_l", "_r").alias("semantic_similarity"), (F.size(prefix("before")) + F.size(prefix("after"))).alias("n_context"))


def context_similarity_by_key(chunked: DataFrame, vectors: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """W3 where an asset may have a vector under each of several keys (``asset_id, key, vector``, one row each).

    The context is formed for each key that a project has; of those whose two
    sides meet, the one with the most vectors counts, ties to the smallest key.
    """
    keys = chunked.select("project_id", "asset_id").join(vectors.select("asset_id", "key"), "asset_id").select("project_id", "key").distinct()
    line = chunked.select("project_id", *ORDER, "chunk").join(keys, "project_id").join(vectors, ["asset_id", "key"], "left")
    got = context_similarity(line.withColumn("project_id", F.struct("project_id", "key")), config).where("semantic_similarity is not null")
    best = F.min(F.struct((-F.col("n_context")).alias("n"), F.col("project_id.key").alias("key"), "semantic_similarity")).alias("b")
    return got.groupBy(F.col("project_id.project_id").alias("project_id"), "asset_id").agg(best).select("project_id", "asset_id", "b.semantic_similarity")


def boundaries(line: DataFrame, cad: DataFrame, semantic: DataFrame | None = None, config: TimelineConfig = TimelineConfig(), only: tuple[str, ...] | None = None) -> DataFrame:
    """Every adjacent pair of a project with its score and category; ``line`` in chunks, or its :func:`gaps` with ``COLUMNS`` where they are at hand."""
    pairs = line if "gap_ms" in line.columns else gaps(line, COLUMNS)
    pairs = pairs.join(cad.select("project_id", "normalizer_gap_ms"), "project_id", "left")
    pairs = pairs.join(semantic, ["project_id", "asset_id"], "left") if semantic is not None else pairs.withColumn("semantic_similarity", F.lit(None).cast("double"))
    score = boundary_score(signals(config), config, only)
    return pairs.withColumn("score", score).withColumn("category", category(F.col("score"), config)).select("project_id", F.col("prev_asset_id").alias("left_asset_id"), F.col("asset_id").alias("right_asset_id"), "score", "category")


def segments(chunked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every asset with the 0-based number of its segment: each moderate or strong boundary starts one."""
    starts = bounds.where("category in ('moderate', 'strong')").select("project_id", F.col("right_asset_id").alias("asset_id"), F.lit(1).alias("starts"))
    # The chunks stay what they are: a running sum needs no new ranges.
    marked = chunked.join(starts, ["project_id", "asset_id"], "left")
    return running_sum(marked, "project_id", ORDER, F.coalesce("starts", F.lit(0)).cast("bigint"), "segment").drop("chunk", "starts")


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Counters and time range of each segment; needs ``decision, rating, starred``."""
    return segmented.groupBy("project_id", "segment").agg(
        F.count(F.lit(1)).alias("n_assets"), F.min("captured_at_unix_ms").alias("start_ms"), F.max("captured_at_unix_ms").alias("end_ms"),
        F.count_if(F.col("decision") == "keep").alias("n_keep"), F.count_if(F.col("decision") == "reject").alias("n_reject"),
        F.count_if(F.col("decision").isNull()).alias("n_unreviewed"), F.count_if(F.coalesce("starred", F.lit(False))).alias("n_starred"),
    )


def representatives(segmented: DataFrame, centrality: Column | None = None, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """The asset of each segment with the best weighted mean of its available factors.

    Factors: ``centrality`` (a cosine with the segment's centroid, if given),
    ``technical_score`` and the human decision (keep 1, review .45, reject 0).  An
    asset without factors competes with 0; ties go to the earliest; a segment
    whose winner has no factors has no score.
    """
    human = F.when(F.col("decision") == "keep", 1.0).when(F.col("decision") == "review", 0.45).when(F.col("decision") == "reject", 0.0)
    tech = F.when(~F.isnan("technical_score"), clamp(F.col("technical_score").cast("double")))
    factors = [(tech, config.technical), (human, config.human)]
    if centrality is not None:
        factors.append(((clamp(centrality, -1.0, 1.0) + 1) / 2, config.centrality))
    total = sum((F.coalesce(f * w, F.lit(0.0)) for f, w in factors), F.lit(0.0))
    weight = sum((F.when(f.isNotNull(), w).otherwise(0.0) for f, w in factors), F.lit(0.0))
    scored = segmented.withColumn("_s", F.when(weight > 0, total / weight))
    key = F.struct((-F.round(F.coalesce("_s", F.lit(0.0)), 9)).alias("s"), F.col("captured_at_unix_ms").alias("t"), F.col("asset_id").alias("i"), F.col("_s").alias("score"))
    return scored.groupBy("project_id", "segment").agg(F.min(key).alias("m")).select("project_id", "segment", F.col("m.i").alias("asset_id"), F.col("m.score").alias("score"))


def timeline_gaps(gapped: DataFrame, cad: DataFrame) -> DataFrame:
    """Gaps longer than the project's normalizer."""
    return gapped.join(cad.select("project_id", "normalizer_gap_ms"), "project_id").where(F.col("gap_ms") > F.col("normalizer_gap_ms")).select("project_id", F.col("prev_asset_id").alias("after_asset_id"), F.col("asset_id").alias("before_asset_id"), "gap_ms")


def medians(rows: DataFrame, by: list[str], value: str, name: str, count: str) -> DataFrame:
    """``by, name, count``: the exact median of each group (of an even count the mean of the middle two), by running counts of the distinct values."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k")).withColumn("_g", F.concat_ws("\x00", *by))
    upto = running_sum(sliced(counted, "_g", [value]), "_g", [value], F.col("_k"), "_upto")
    whole = counted.groupBy("_g").agg(F.sum("_k").alias("_n"))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value)))
    two = upto.join(whole, "_g").groupBy(*by, "_n").agg(at(F.floor((F.col("_n") - 1) / 2)).alias("_a"), at(F.floor(F.col("_n") / 2)).alias("_b"))
    return two.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(name), F.col("_n").alias(count))


def clock_offsets(assets: DataFrame, least_sets: int = 3, least_ms: int = 60_000, spread_ms: int = 15_000) -> DataFrame:
    """Pairs of cameras whose clocks differ steadily.

    Of each similar set the nearest two frames of different cameras count; a pair
    of cameras is reported if enough sets agree with their median offset, which is
    long enough.  Sets and camera names are trimmed; blank ones don't count.
    """
    rows = assets.where("captured_at_unix_ms is not null and similar_set_ids is not null and trim(camera_model) != ''").select(
        "project_id", F.trim("camera_model").alias("cam"), F.col("captured_at_unix_ms").alias("t"), F.explode(F.array_distinct(F.transform("similar_set_ids", lambda s: F.trim(s)))).alias("set_id")
    )
    members = rows.where("set_id != ''").distinct()
    chunks = sliced(members.withColumn("set_key", F.concat_ws("\x00", "project_id", "set_id")), "set_key", ["t", "cam"])
    pairs = neighbours(chunks, "set_key", ["t", "cam"], ["cam", "t"], "p_").where("p_cam != cam")
    swap = F.col("p_cam") < F.col("cam")
    a, b = F.struct(F.col("p_cam").alias("c"), F.col("p_t").alias("t")), F.struct(F.col("cam").alias("c"), F.col("t").alias("t"))
    sided = pairs.withColumns({"a": F.when(swap, a).otherwise(b), "b": F.when(swap, b).otherwise(a)})
    near = sided.groupBy("project_id", "set_id").agg(F.min(F.struct(F.abs(F.col("a.t") - F.col("b.t")).alias("d"), F.col("a.c").alias("camera_a"), F.col("b.c").alias("camera_b"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb"))).alias("n"))
    offs = near.select("project_id", "set_id", "n.camera_a", "n.camera_b", (F.col("n.tb") - F.col("n.ta")).alias("offset_ms"))
    by = ["project_id", "camera_a", "camera_b"]
    # The median of an even count is the mean of the middle two, cut towards zero.
    med = medians(offs, by, "offset_ms", "median_ms", "n_sets").withColumn("median_ms", F.col("median_ms").cast("bigint"))
    dev = offs.join(med, by).withColumn("dev", F.abs(F.col("offset_ms") - F.col("median_ms")))
    most = dev.groupBy(*by, "median_ms", "n_sets").agg(F.max("dev").alias("most_dev"))
    far = most.join(medians(dev, by, "dev", "mad_ms", "_n").drop("_n"), by).withColumn("mad_ms", F.floor("mad_ms").cast("bigint"))
    return far.where((F.col("n_sets") >= least_sets) & (F.abs("median_ms") >= least_ms) & (F.col("most_dev") <= spread_ms)).select(*by, "median_ms", "mad_ms", "n_sets")
