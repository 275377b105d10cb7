"""Incremental processing (T1-T5): append-only tails, late data, file-source streams.

Late data is never dropped: a watermark alone would drop it, so each micro-batch
is compared with the tail of its project and either extends it or asks for a
rebuild (T3).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def classify_append(existing: DataFrame, batch: DataFrame, project: str = "project_id", ts: str = "captured_at_unix_ms", key: str = "asset_id", ignore: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    """What each project's new rows ask for: ``no_change``, ``undated_only``, ``tail`` or ``rebuild``.

    Rows sent again unchanged (but for ``ignore``) don't count; a known key with
    other values counts by its new and its old time, the old one in its old
    project.  A time at or before the project's last one needs a rebuild.
    """
    tails = existing.groupBy(project).agg(F.max(ts).alias("tail"))
    same = F.lit(True)
    for c in existing.columns:
        if c in batch.columns and c not in (key, *ignore):
            same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}"))
    sent = batch.alias("b").join(existing.alias("e"), F.col(f"b.{key}") == F.col(f"e.{key}"), "left").where(F.col(f"e.{key}").isNull() | ~same)
    now = sent.select(F.col(f"b.{project}").alias(project), F.col(f"b.{ts}").alias("t"), F.lit(1).alias("one"))
    was = sent.where(F.col(f"e.{ts}").isNotNull()).select(F.col(f"e.{project}").alias(project), F.col(f"e.{ts}").alias("t"), F.lit(0).alias("one"))
    asked = now.unionByName(was).groupBy(project).agg(F.sum("one").alias("n_new"), F.min("t").alias("first_new"), F.count("t").alias("n_dated"))
    news = batch.select(project).union(was.select(project)).distinct().join(asked, project, "left").join(tails, project, "left")
    kind = F.when(F.col("n_dated").isNull(), "no_change").when(F.col("n_dated") == 0, "undated_only").when(F.col("tail").isNull() | (F.col("first_new") > F.col("tail")), "tail").otherwise("rebuild")
    return news.select(project, F.coalesce("n_new", F.lit(0)).alias("n_new"), kind.alias("disposition"))


def classify_changed(assets: DataFrame, changed: DataFrame, tails: DataFrame, project: str = "project_id", ts: str = "captured_at_unix_ms", key: str = "asset_id") -> DataFrame:
    """What the declared ``changed`` keys ask of each project, given its last time analysed before (``tails``: project, ``tail``).

    A key that ``assets`` doesn't have is an error.  Without an earlier tail, with
    a change at or before it, or with a later asset that wasn't declared, a
    project with dated changes needs a rebuild.
    """
    ids = changed.select(key).distinct()
    unknown = ids.join(assets.select(key), key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown changed id {unknown[0][0]}")
    marked = assets.select(key, project, ts).join(ids, key, "left_semi").withColumn("said", F.lit(True)).unionByName(assets.select(key, project, ts).join(ids, key, "left_anti").withColumn("said", F.lit(False)))
    t, said = F.col(ts), F.col("said")
    of = marked.join(tails, project, "left").groupBy(project).agg(
        F.count_if(said).alias("n"), F.count_if(said & t.isNotNull()).alias("dated"),
        F.count_if(t.isNotNull() & F.when(said, F.col("tail").isNull() | (t <= F.col("tail"))).otherwise(t > F.col("tail"))).alias("bad"),
    )
    kind = F.when(F.col("n") == 0, "no_change").when(F.col("dated") == 0, "undated_only").when(F.col("bad") == 0, "tail").otherwise("rebuild")
    return of.select(project, kind.alias("disposition"))


def tail_input(existing: DataFrame, batch: DataFrame, k: int = 4, project: str = "project_id", order: tuple[str, ...] = ("captured_at_unix_ms", "asset_id")) -> DataFrame:
    """The last ``k`` rows of each project (context) with its new rows.

    The context is limited before the shuffle (window group limit).
    """
    from pyspark.sql import Window as W

    last = existing.where(F.col(order[0]).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(project).orderBy(*[F.desc(o) for o in order]))).where(F.col("_r") <= k).drop("_r")
    return last.withColumn("context", F.lit(True)).unionByName(batch.withColumn("context", F.lit(False)))


def replay_files(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], per_batch: int = 1) -> None:
    """T4, T5: all files of a folder as micro-batches, in order of arrival, each handled once; resumes from its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, key: str) -> DataFrame:
    """Tumbling counts of a stream (an addition): times must be TIMESTAMP, so wall-clock ones are cast under the session's zone."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_ts", late).groupBy(F.window("_ts", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
