"""Queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, load
from .canonical import match_metadata
from .clusters import cluster_members, describe
from .encode import build_lexicon, count_tokens, encode, vocabulary_of
from .mixing import plan_mix, shares
from .neighbours import asset_neighbours, pairs_found, valid_vectors
from .ranking import counting_choices, global_ranks, set_winners, strengths
from .reading import fit_from_tables, score_documents
from .survivors import preferred_copies


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of the gear list that each written make, model and lens means, -1 if none."""
    return match_metadata(load(spark, sf, "media_metadata"), load(spark, sf, "gear_ref")).select("metadata_id", "field_name", "ref_id")


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Written values that mean no entry, with the number of rows that hold them."""
    got = match_metadata(load(spark, sf, "media_metadata"), load(spark, sf, "gear_ref"))
    return got.where("ref_id = -1").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The copy to deliver of each asset with at least two copies, one of them available."""
    return preferred_copies(load(spark, sf, "delivery_source")).where("n_copies >= 2 and n_available >= 1").select("asset_id", "file_instance_id")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every asset with its copies, available ones and the state of the preferred one."""
    return preferred_copies(load(spark, sf, "delivery_source")).select("asset_id", "n_copies", "n_available", "file_instance_id", "verified", "checked", "seen_us")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each cluster of similar frames against its smallest member."""
    return cluster_members(load(spark, sf, "fingerprint_evidence")).where("asset_id != cluster_id").select(F.col("cluster_id").alias("asset_a"), F.col("asset_id").alias("asset_b"))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster's size and typical members."""
    return describe(cut(cluster_members(load(spark, sf, "fingerprint_evidence"))))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Both vector tables as ``kind, asset_id, vec``; fingerprints have 64 values and are one kind."""
    sem = valid_vectors(load(spark, sf, "semantic_vector"), "compatibility_key", "asset_id", "vector_values", "embedded_at")
    fin = load(spark, sf, "fingerprint_evidence").select(F.lit("fingerprint").alias("kind"), "asset_id", "embedding")
    return sem.select(F.concat(F.lit("semantic/"), "kind").alias("kind"), "asset_id", "vec").unionByName(valid_vectors(fin, "kind", "asset_id", "embedding", length=64))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of assets of which one is among the 5 most similar of the other."""
    found = pairs_found(asset_neighbours(_vectors(spark, sf)))
    return found.select(F.split_part("kind", F.lit("/"), F.lit(1)).alias("vector_kind"), F.col("a").alias("asset_a"), F.col("b").alias("asset_b")).distinct()


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar other assets of every asset and kind, with their cosine."""
    return asset_neighbours(_vectors(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The globally strongest asset of each set with three or more compared assets."""
    choices = cut(counting_choices(load(spark, sf, "pairwise_preference")))
    return set_winners(choices, strengths(choices, errors=False))


def p7_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All compared assets in one ranking, with strength, standard error and component."""
    choices = cut(counting_choices(load(spark, sf, "pairwise_preference")))
    ranked = global_ranks(strengths(choices))
    return ranked.withColumns({"strength": F.round("strength", 6), "std_error": F.round("std_error", 6)})


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    docs = load(spark, sf, "documents")
    where = vocabulary_of(spark)
    return encode(docs, ["doc_id"], "text", build_lexicon(spark, docs, vocabulary=where), where)


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    wanted = load(spark, sf, "mix_target").where("source is not null").select("source").distinct()
    # mix_target doesn't grow (nine rows): the broadcast is bounded by it.
    mine = docs.select("doc_id", "source", "text").join(F.broadcast(wanted), "source", "left_semi")
    where = vocabulary_of(spark)
    return cut(count_tokens(mine, ["doc_id", "source"], "text", build_lexicon(spark, docs, vocabulary=where), where))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in the mix with its tokens and how often it is used."""
    mix, _, _ = plan_mix(_counted(spark, sf), load(spark, sf, "mix_target"))
    return mix


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all tokens that each source reaches, beside its target."""
    targets = load(spark, sf, "mix_target")
    mix, _, _ = plan_mix(_counted(spark, sf), targets)
    return shares(cut(mix), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reading band of every document with prose."""
    docs = load(spark, sf, "documents")
    return score_documents(docs, fit_from_tables(docs, load(spark, sf, "reading_label"))).select("doc_id", "reading_band")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score and band of every document with prose."""
    docs = load(spark, sf, "documents")
    return score_documents(docs, fit_from_tables(docs, load(spark, sf, "reading_label"))).withColumn("score", F.round("score", 6))


QUERIES = {
    "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found,
    "p6_neighbours": p6_neighbours, "p7_found": p7_found,
    "p7_ranking": p7_ranking, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores,
}

_COPIES = r"""
    obs AS (
        SELECT asset_id, file_instance_id, coalesce(available, false) AS available, coalesce(verified, false) AS verified,
               coalesce(regexp_replace(content_checksum, '\s', '', 'g') <> '', false) AS checked,
               epoch_us(try_cast(CASE WHEN regexp_matches(observed_at, '^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d+)?\s*([Zz]|[+-]\d{2}:?\d{2})\s*$')
                   THEN regexp_replace(regexp_replace(replace(upper(trim(observed_at)), 'Z', '+00:00'), '([+-]\d{2}):?(\d{2})$', '\1:\2'), 'T', ' ') END AS TIMESTAMPTZ)) AS seen_us
        FROM delivery_source WHERE asset_id IS NOT NULL AND file_instance_id IS NOT NULL),
    latest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, file_instance_id
            ORDER BY seen_us DESC NULLS LAST, available DESC, verified DESC, checked DESC) AS rn FROM obs) WHERE rn = 1),
    best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id
            ORDER BY verified DESC, checked DESC, seen_us DESC NULLS LAST, file_instance_id) AS place FROM latest WHERE available) WHERE place = 1),
    counts AS (SELECT asset_id, count(*) AS n_copies, count(*) FILTER (available) AS n_available FROM latest GROUP BY asset_id)"""

ORACLE = {
    "p4_found": f"WITH {_COPIES} SELECT asset_id, file_instance_id FROM counts JOIN best USING (asset_id) WHERE n_copies >= 2",
    "p4_report": f"""WITH {_COPIES} SELECT c.asset_id, n_copies, n_available, b.file_instance_id, b.verified, b.checked, b.seen_us
        FROM counts c LEFT JOIN best b ON c.asset_id = b.asset_id""",
}

_D = "::DOUBLE"
_SUM = lambda e: f"list_sum({e})::DOUBLE"
_POINTS = r"""
    f AS (SELECT DISTINCT project_id, asset_id, ('0x' || perceptual_hash)::UBIGINT AS h, color_signature AS c, embedding AS e FROM fingerprint_evidence
          WHERE asset_id IS NOT NULL AND project_id IS NOT NULL AND regexp_full_match(perceptual_hash, '[0-9a-fA-F]{16}') AND len(color_signature) > 0 AND len(embedding) > 0)"""
_LINKS = f"""
    d AS (SELECT x.asset_id AS a, y.asset_id AS b, x.project_id, bit_count(xor(x.h, y.h))::INT AS dist, x.c AS xc, y.c AS yc, x.e AS xe, y.e AS ye FROM f x JOIN f y ON x.project_id = y.project_id AND x.asset_id < y.asset_id WHERE bit_count(xor(x.h, y.h)) <= 10),
    s AS (SELECT *, CASE WHEN len(xc) = len(yc) THEN 1.0{_D} - {_SUM('list_transform(list_zip(xc, yc), lambda p: abs(p[1]::INT - p[2]::INT))')} / (len(xc) * 255.0{_D}) ELSE 0.0{_D} END AS cs,
          {_SUM('list_transform(xe, lambda p: p::INT * p::INT)')} AS xx, {_SUM('list_transform(ye, lambda p: p::INT * p::INT)')} AS yy, CASE WHEN len(xe) = len(ye) THEN {_SUM('list_transform(list_zip(xe, ye), lambda p: p[1]::INT * p[2]::INT)')} END AS xy FROM d),
    l AS (SELECT a, b FROM s WHERE (1.0{_D} - dist / 64.0{_D}) * 0.60{_D} + cs * 0.15{_D} + CASE WHEN xy IS NULL THEN 0.0{_D} WHEN xx > 0 AND yy > 0 THEN (xy / (sqrt(xx) * sqrt(yy)) + 1.0{_D}) / 2.0{_D} ELSE 0.5{_D} END * 0.25{_D} >= 0.86{_D}),
    u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other), m AS (SELECT node, min(other) AS label FROM r GROUP BY node)"""
_VECTORS = f"""
    raw AS (SELECT 'semantic' AS vk, compatibility_key AS k, asset_id, vector_values{_D}[] AS v, embedded_at AS t FROM semantic_vector WHERE compatibility_key IS NOT NULL UNION ALL SELECT 'fingerprint', 'fingerprint', asset_id, embedding{_D}[], NULL FROM fingerprint_evidence),
    ok AS (SELECT * FROM raw WHERE asset_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    dim AS (SELECT vk, k, CASE WHEN vk = 'fingerprint' THEN 64 ELSE max_by(d, (n, -d)) END AS d FROM (SELECT vk, k, len(v) AS d, count(*) AS n FROM ok GROUP BY ALL) GROUP BY vk, k),
    one AS (SELECT vk, k, asset_id, v FROM (SELECT ok.*, row_number() OVER (PARTITION BY vk, k, asset_id ORDER BY t DESC NULLS LAST, v DESC) AS n FROM ok JOIN dim USING (vk, k) WHERE len(v) = dim.d) WHERE n = 1),
    sim AS (SELECT x.vk, x.asset_id AS a, y.asset_id AS b, row_number() OVER (PARTITION BY x.vk, x.k, x.asset_id ORDER BY round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) DESC, y.asset_id) AS place
            FROM one x JOIN one y ON x.vk = y.vk AND x.k = y.k AND x.asset_id <> y.asset_id)"""
ORACLE |= {
    "p5_found": f"WITH RECURSIVE {_POINTS}, {_LINKS} SELECT label AS asset_a, node AS asset_b FROM m WHERE node <> label",
    "p6_found": f"WITH {_VECTORS} SELECT DISTINCT vk AS vector_kind, least(a, b) AS asset_a, greatest(a, b) AS asset_b FROM sim WHERE place <= 5",
}
ORACLE |= {
    "p5_clusters": f"""WITH RECURSIVE {_POINTS}, {_LINKS}, c AS (SELECT f.project_id, m.label AS cluster_id, f.asset_id, f.h FROM m JOIN f ON f.asset_id = m.node),
        z AS (SELECT *, unnest([0, 1, 2, 3]) AS band FROM c), y AS (SELECT *, ((h >> (16 * band)::UBIGINT) & 65535::UBIGINT) AS cell FROM z), n AS (SELECT cluster_id, band, cell, count(*) AS k FROM y GROUP BY ALL),
        dense AS (SELECT cluster_id, asset_id, sum(k) AS density FROM y JOIN n USING (cluster_id, band, cell) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY density DESC, asset_id) AS place FROM dense)
        SELECT project_id, cluster_id, count(*) AS n_members, (SELECT string_agg(asset_id, ',' ORDER BY place) FROM t WHERE t.cluster_id = c.cluster_id AND place <= 3) AS typical_members FROM c GROUP BY project_id, cluster_id""",
    "p6_neighbours": f"""WITH {_VECTORS.replace("y.asset_id AS b,", "y.asset_id AS b, x.k, round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS cosine,")}
        SELECT CASE WHEN vk = 'semantic' THEN 'semantic/' || k ELSE k END AS kind, a AS asset_id, b AS other, cosine, place::INT AS place FROM sim WHERE place <= 5""",
}
# The plain steps of minorisation-maximisation, without components, buckets or shortcuts.
ORACLE["p7_found"] = """WITH RECURSIVE
    ch AS (SELECT preference_id, min({'c': chosen_asset_id, 'a': alternative_asset_id, 's': similarity_set_id}) AS x FROM pairwise_preference
        WHERE training_eligible AND preference_id IS NOT NULL AND chosen_asset_id <> alternative_asset_id GROUP BY 1),
    g AS (SELECT x.c AS i, x.a AS j, 1 AS won FROM ch UNION ALL SELECT x.a, x.c, 0 FROM ch), pr AS (SELECT i, j, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2), w AS (SELECT i, sum(won) + 0.5::DOUBLE AS w FROM g GROUP BY 1),
    it AS (SELECT 0 AS step, i, 1.0::DOUBLE AS pi FROM w
        UNION ALL SELECT s.step + 1, s.i, any_value(w.w) / (sum(pr.n / (s.pi + o.pi)) + 1.0::DOUBLE / (any_value(s.pi) + 1)) FROM it s JOIN pr ON pr.i = s.i JOIN it o ON o.i = pr.j JOIN w ON w.i = s.i WHERE s.step < 1500 GROUP BY s.step, s.i),
    st AS (SELECT i, ln(pi) AS s FROM it WHERE step = 1500), m AS (SELECT DISTINCT x.s AS k, unnest([x.c, x.a]) AS i FROM ch WHERE x.s IS NOT NULL),
    r AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY round(s, 7) DESC, i) AS place, count(*) OVER (PARTITION BY k) AS n FROM m JOIN st USING (i))
    SELECT k AS similarity_set_id, i AS asset_id FROM r WHERE place = 1 AND n >= 3"""
