"""Best representative of each duplicate group: rank by state, trust and recency, keep the first.

Both choices are ``row_number() = 1`` filters.  Spark limits each group before
the shuffle (window group limit), so a group of any size sends at most one row
a task to the task that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import merge_join

# Fixed value: a date and time with an offset, as observation times are written.
_TIME = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,6})\d*)?\s*(?:([Zz])|([+-]\d{2}):?(\d{2}))\s*$"


def instant_us(text: str | Column) -> Column:
    """Microseconds since 1970 of a written time with offset; null for what is missing or unusable."""
    t = F.col(text) if isinstance(text, str) else text
    part = lambda i: F.regexp_extract(t, _TIME, i)
    east = F.when(part(5) == "", F.lit(0)).otherwise(
        F.when(part(5).startswith("-"), -1).otherwise(1) * (F.abs(part(5).try_cast("int")) * 60 + part(6).try_cast("int"))
    )
    wall = F.concat(part(1), F.lit(" "), part(2), F.lit("."), F.rpad(part(3), 6, "0"), F.lit("+00:00")).try_cast("timestamp")
    return F.when(t.rlike(_TIME) & (F.abs(east) <= 14 * 60), F.unix_micros(wall) - east.cast("bigint") * 60_000_000)


def first_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``; give a total order for a unique result."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_copies(sources: DataFrame) -> DataFrame:
    """The counting observation of each copy (``asset_id, file_instance_id``).

    The latest instant counts, a missing or unusable one being the oldest; equal
    instants go to the available, then verified, then checksummed observation, so
    that repeated rows give the same result.  Null flags are false, a blank
    checksum is missing.  Rows without either id are left out.
    """
    slim = sources.where("asset_id is not null and file_instance_id is not null").select(
        "asset_id", "file_instance_id", instant_us("observed_at").alias("seen_us"),
        F.coalesce("available", F.lit(False)).alias("available"), F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce(F.trim(F.regexp_replace("content_checksum", r"\s", "")) != "", F.lit(False)).alias("checked"),
    )
    order = [F.col("seen_us").desc_nulls_last(), F.col("available").desc(), F.col("verified").desc(), F.col("checked").desc()]
    return first_of(slim, ["asset_id", "file_instance_id"], order)


def preferred_copies(sources: DataFrame) -> DataFrame:
    """Per asset: the copy to deliver (null where none is available), its state and the number of copies.

    Available copies only, in the order verified, checksum present, observed
    last, smallest id.
    """
    latest = latest_copies(sources)
    counts = latest.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_copies"), F.count_if("available").alias("n_available"))
    order = [F.col("verified").desc(), F.col("checked").desc(), F.col("seen_us").desc_nulls_last(), F.col("file_instance_id")]
    best = first_of(latest.where("available"), ["asset_id"], order).drop("available")
    return merge_join(counts, best, "asset_id", "left")
