"""Exact and approximate vector search, centroids and label assignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import cosine, dot, flip_one_bit, normalize, valid_vector
from ..session import few_or_merged

TABLES, BITS, EXACT_MOST = 4, 16, 4096
_BLOCK_ROWS, _BLOCK_QUERIES = 4096, 512
TOP_LEAST, MARGIN_LEAST = 0.32, 0.06


def knn_exact(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the highest cosine with one query; ties to the smaller id.

    Invalid vectors and those of another length are skipped; ``where`` (P8) is
    applied first, so that it reaches the scan.
    """
    rows = vectors if where is None else vectors.where(where)
    q = np.asarray(query, dtype=float)
    if not len(q) or not np.isfinite(q).all() or not q.any():
        return rows.select(F.col(id_column), F.lit(None).cast("double").alias("score")).limit(0)
    unit = F.array(*[F.lit(float(x)) for x in q / np.linalg.norm(q)])
    valid = rows.where(valid_vector(vector) & (F.size(vector) == len(q)))
    scored = valid.select(F.col(id_column), (dot(vector, unit) / F.sqrt(dot(vector, vector))).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """J7 for a table of queries: ``query_id``, the id and the score of the k vectors nearest to each; ties (12 decimals) to the smaller id.

    ``queries`` has ``query_id`` and the vector.  Queries and rows are put into
    blocks by the hash of their ids and every pair of blocks is one product of two
    bounded matrices, so both sides may grow.
    """
    rows = vectors if where is None else vectors.where(where)
    kind = vectors.schema[id_column].dataType.simpleString()
    asks = queries.schema["query_id"].dataType.simpleString()
    v, d = normalize(vector).alias("v"), F.size(vector).alias("d")
    left = rows.where(valid_vector(vector)).select(F.col(id_column).alias("id"), d, v)
    right = queries.where(valid_vector(vector)).select("query_id", d, v)
    n_left, n_right = left.count() // _BLOCK_ROWS + 1, right.count() // _BLOCK_QUERIES + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = left.withColumn("rb", block("id", n_left)).withColumn("qb", every(n_right))
    right = right.withColumn("qb", block("query_id", n_right)).withColumn("rb", every(n_left))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        a = a.sort_values("id", ignore_index=True)
        scores = np.stack(b["v"].to_numpy()) @ np.stack(a["v"].to_numpy()).T
        top = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), top.shape[1]), "id": a["id"].to_numpy()[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()})

    by = ["d", "rb", "qb"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, f"query_id {asks}, id {kind}, score double")
    return _best(met, k).withColumnRenamed("id", id_column)


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def planes(dimension: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """H6: ±1 planes (tables * bits, dimension) from one digest bit each, the same on every machine."""
    out = np.empty((tables * bits, dimension), dtype=np.float64)
    for t in range(tables):
        for b in range(bits):
            for d in range(dimension):
                out[t * bits + b, d] = 1.0 if hashlib.md5(f"{t}:{b}:{d}".encode()).digest()[0] & 1 else -1.0
    return out


def with_signatures(vectors: DataFrame, dimension: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """H6: ``id, table, signature``, one row a table; a bit is set where the projection is not negative."""
    p = planes(dimension)
    weights = 1 << np.arange(BITS)

    @F.pandas_udf("array<int>")
    def sign(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        on = (np.stack(v.to_numpy()).astype(np.float64) @ p.T >= 0).reshape(len(v), TABLES, BITS)
        return pd.Series(list((on * weights).sum(axis=2).astype(np.int32)))

    ok = vectors.where(valid_vector(vector) & (F.size(vector) == dimension))
    return ok.select(id_column, F.posexplode(sign(vector)).alias("table", "signature"))


def lsh_candidates(index: DataFrame, query_signatures: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """``query_id`` and id, distinct, of all vectors in each query's buckets or one bit beside them."""
    probes = query_signatures.select("query_id", "table", F.explode(flip_one_bit("signature")).alias("signature"))
    return index.join(probes, ["table", "signature"]).select("query_id", id_column).distinct()


def knn_lsh_many(vectors: DataFrame, index: DataFrame, queries: DataFrame, dimension: int, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", exact_most: int = EXACT_MOST) -> DataFrame:
    """J8 for a table of queries (``query_id`` and the vector): exact search up to ``exact_most`` vectors, else exact ranking of all LSH candidates."""
    queries = queries.where(F.size(vector) == dimension)
    if vectors.limit(exact_most + 1).count() <= exact_most:
        return knn_many(vectors, queries, k, None, id_column, vector)
    found = lsh_candidates(index, with_signatures(queries, dimension, "query_id", vector), id_column)
    left = vectors.where(valid_vector(vector) & (F.size(vector) == dimension)).select(id_column, normalize(vector).alias("_v"))
    right = queries.where(valid_vector(vector)).select("query_id", normalize(vector).alias("_w"))
    scored = found.join(left, id_column).join(right, "query_id").select("query_id", F.col(id_column).alias("id"), dot("_v", "_w").alias("score"))
    return _best(scored, k).withColumnRenamed("id", id_column)


def knn_lsh(vectors: DataFrame, index: DataFrame, query: list[float], k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """J8 for one query, best first."""
    q = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], f"query_id bigint, {vector} array<double>")
    return knn_lsh_many(vectors, index, q, len(query), k, id_column, vector).drop("query_id").orderBy(F.desc(F.round("score", 12)), id_column)


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, n, centroid``: the mean of the valid vectors, unit length; null for mixed lengths or a zero mean."""
    ok = vectors.where(valid_vector(vector)).select(F.col(group), F.col(vector).alias("_v"))
    parts = ok.select(group, F.posexplode("_v").alias("_i", "_x")).groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c"), F.max("_n").alias("n"), F.min("_n").alias("_least"))
    return whole.select(group, "n", F.when(F.col("_least") == F.col("n"), normalize("_c")).alias("centroid"))


def dominant_key(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The most frequent key of each group, ties to the smallest."""
    n = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k"))).alias("t")).select(group, F.col("t.k").alias(key), (-F.col("t.m")).alias("n"))


def label_candidates(targets: DataFrame, candidates: DataFrame, id_column: str, label: str, vector: str = "vector") -> DataFrame:
    """Each target's best label, its lead over the second, and whether both suffice.

    ``candidates`` are the labels' vectors: a short list, which goes to every task
    once it is counted.  Each task keeps its targets' best two.
    """
    left = targets.select(id_column, F.col(vector).alias("_v"), F.size(vector).alias("_d"))
    right = candidates.select(label, F.col(vector).alias("_w"), F.size(vector).alias("_d"))
    scored = left.join(few_or_merged(right), "_d").select(id_column, label, cosine("_v", "_w").alias("similarity")).where("similarity is not null")
    place = F.row_number().over(W.partitionBy(id_column).orderBy(F.desc("similarity"), label))
    two = scored.withColumn("_r", place).where(F.col("_r") <= 2).groupBy(id_column)
    first = lambda x: F.max(F.when(F.col("_r") == 1, F.col(x))).alias(x)
    best = two.agg(first(label), first("similarity"), F.max(F.when(F.col("_r") == 2, F.col("similarity"))).alias("second"))
    enough = (F.col("similarity") >= TOP_LEAST) & (F.col("second").isNull() | (F.col("similarity") - F.col("second") >= MARGIN_LEAST))
    return best.withColumn("accepted", enough)


def label_state(targets: DataFrame, candidates: DataFrame, id_column: str, least: int = 1, time_only: bool = False) -> DataFrame:
    """P20: ``state`` of each target: suggested, abstained or semantic_evidence_unavailable.

    ``targets`` has the id and ``n_vectors`` behind its centroid (null or 0 for
    none), ``candidates`` is the result of :func:`label_candidates`.
    """
    n = F.col("n_vectors")
    none = F.lit(time_only) | n.isNull() | (n == 0)
    state = F.when(none, "semantic_evidence_unavailable").when((n < least) | ~F.coalesce("accepted", F.lit(False)), "abstained").otherwise("suggested")
    return targets.select(id_column, "n_vectors").join(candidates.select(id_column, "accepted"), id_column, "left").select(id_column, state.alias("state"))


# Concepts of which a label may hold one only.
CONFLICTS = {"indoor": "place", "outdoor": "place", "close-up": "framing", "wide": "framing", "one person": "people", "multiple people": "people", "group": "people"}


def resolve_concepts(scores: DataFrame, most: int = 3) -> DataFrame:
    """of ``segment, concept, similarity`` the concepts kept, best first.

    Below ``TOP_LEAST`` none counts; of conflicting ones the best is kept if it
    leads by the margin, else none of them; the best ``most`` remain.
    """
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFLICTS.items() for x in kv]), F.col("concept")), F.concat(F.lit("="), "concept"))
    w = W.partitionBy("segment", "_set").orderBy(F.desc("similarity"), "concept")
    lead = scores.where(F.col("similarity") >= TOP_LEAST).withColumn("_set", of).withColumns({"_r": F.row_number().over(w), "_s": F.lead("similarity").over(w)})
    kept = lead.where((F.col("_r") == 1) & (F.col("_s").isNull() | (F.col("similarity") - F.col("_s") >= MARGIN_LEAST)))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("segment").orderBy(F.desc("similarity"), "concept"))).where(F.col("place") <= most).select("segment", "concept", "similarity", "place")


def compose_label(concepts: str | Column) -> Column:
    """words for a set of concepts: setting, framing, boat, subject, water; a wide view stands alone."""
    has = lambda x: F.array_contains(concepts, x)
    setting = F.when(has("indoor"), "indoor").when(has("outdoor"), "outdoor")
    framing = F.when(has("close-up"), "close-up")
    who = F.when(has("group"), "group").when(has("multiple people"), "people").when(has("one person"), "portrait")
    text = F.concat_ws(" ", setting, framing, F.when(has("boat"), "boat"), who, F.when(has("water"), "by water"))
    text = F.when(has("wide"), F.concat_ws(" ", F.lit("wide"), F.when(has("boat"), "boat"), F.lit("view"))).otherwise(text)
    return F.when(text != "", F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 200)))
