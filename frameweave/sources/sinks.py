"""Report and handoff sinks (S12-S14, S16, S18); all refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import csv_cell, file_name, html_text, safe_relative_path
from ..operators.checks import EXCLUSIONS


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV without cells that a spreadsheet would run."""
    safe = rows.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^([=+\-@])", "'$1").alias(c) for c in rows.columns])
    safe.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Each row as one CSV line."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in rows.columns]).alias("line"))


def html_rows(rows: DataFrame) -> DataFrame:
    """Each row as one escaped table row."""
    cells = [F.concat(F.lit("<td>"), html_text(F.col(c).cast("string")), F.lit("</td>")) for c in rows.columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


# The columns of the handoff table.
HANDOFF = ("handoff_filename", "original_filename", "capture_time", "camera", "rating", "star", "human_selection", "moment_label", "work_item_status")


def handoff_rows(items: DataFrame) -> DataFrame:
    """The nine columns of the handoff table; every item is queued."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    name = F.coalesce(F.when(file_name("handoff_relative_path") != "", file_name("handoff_relative_path")), F.col("original_filename"))
    return items.select(
        name.alias("handoff_filename"), "original_filename", text("captured_at").alias("capture_time"), text("camera").alias("camera"), text("rating").alias("rating"),
        F.when(F.coalesce("starred", F.lit(False)), "true").otherwise("false").alias("star"), text("human_decision").alias("human_selection"), text("moment_label").alias("moment_label"), F.lit("queued").alias("work_item_status"),
    )


def handoff_manifests(items: DataFrame, handoffs: DataFrame, version: int = 1) -> DataFrame:
    """``handoff_id, manifest, checksum``: each handoff as one JSON document, its items in the order of their ids.

    ``handoffs``: one row each with ``handoff_id`` and what describes it; ``items``:
    ``handoff_id, work_item_id, handoff_relative_path, ...``.  Only the given columns
    are written; a handoff with an unsafe path is refused with all others.  A
    handoff is a document for one person's editor, so its items fit one row.
    """
    if not items.where(~safe_relative_path("handoff_relative_path")).isEmpty():
        raise ValueError("a handoff has an unsafe path")
    fields = ["work_item_id", *sorted(c for c in items.columns if c not in ("handoff_id", "work_item_id"))]
    listed = items.groupBy("handoff_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("work_items"))
    exclusions = F.map_from_arrays(F.array(*[F.lit(f"{x}_excluded") for x in EXCLUSIONS]), F.array(*[F.lit(True)] * len(EXCLUSIONS)))
    head = [F.lit(version).alias("schema_version"), *sorted(handoffs.columns), exclusions.alias("privacy"), F.coalesce("work_items", F.array().cast(listed.schema["work_items"].dataType)).alias("work_items")]
    text = handoffs.join(listed, "handoff_id", "left").select("handoff_id", F.to_json(F.struct(*head)).alias("manifest"))
    return text.withColumn("checksum", F.sha2("manifest", 256))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("errorifexists").json(path)


def delivery_report(entries: DataFrame, plan: str, status: str = "status", size: str = "byte_size") -> DataFrame:
    """The terminal summary of each plan as JSON: counts and bytes only, no paths or names."""
    s = entries.groupBy(plan).agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col(status) == "verified").alias("n_verified"), F.count_if(F.col(status) == "failed").alias("n_failed"), F.sum(size).alias("total_bytes"))
    return s.select(plan, F.to_json(F.struct("n_entries", "n_verified", "n_failed", "total_bytes")).alias("report"))


def copy_verified(entries: DataFrame, root: str) -> DataFrame:
    """Copy ``source, relative_path`` below ``root`` and verify; one outcome a row.

    Each file goes to a partial of its own, hashed while it is written and again
    when read back, and takes its final name without replacing anything, so a task
    that runs twice finds its own work: the same content there is ``verified``, other
    content a ``conflict``.  ``root`` must be a mounted folder.
    """
    import os
    import uuid
    from collections.abc import Iterator

    import pandas as pd

    def one(source: str, rel: str) -> tuple[str, str | None, int]:
        import hashlib

        def digest(path: str) -> str:
            h = hashlib.sha256()
            with open(path, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            return h.hexdigest()

        parts = (rel or "").replace("\\", "/").split("/")
        if not rel or rel.startswith("/") or any(p in ("", ".", "..") for p in parts):
            return "unsafe_path", None, 0
        final = os.path.join(root, *parts)
        partial = f"{final}.{uuid.uuid4().hex}.partial"
        try:
            before = os.stat(source)
            os.makedirs(os.path.dirname(final), exist_ok=True)
            h, n = hashlib.sha256(), 0
            with open(source, "rb") as a, open(partial, "wb") as b:
                while block := a.read(1 << 20):
                    h.update(block)
                    b.write(block)
                    n += len(block)
                b.flush()
                os.fsync(b.fileno())
            after = os.stat(source)
            if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
                return "source_changed", None, n
            if digest(partial) != h.hexdigest():
                return "verification_failed", None, n
            try:
                os.link(partial, final)
            except FileExistsError:
                return ("verified" if digest(final) == h.hexdigest() else "conflict"), h.hexdigest(), n
            return "verified", h.hexdigest(), n
        except OSError as e:
            return f"failed:{e.strerror}", None, 0
        finally:
            if os.path.exists(partial):
                os.unlink(partial)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(s, r, *one(s, r)) for s, r in zip(pdf["source"], pdf["relative_path"])]
            yield pd.DataFrame(got, columns=["source", "relative_path", "status", "content_hash", "byte_size"])

    return entries.select("source", "relative_path").mapInPandas(run, "source string, relative_path string, status string, content_hash string, byte_size bigint")
