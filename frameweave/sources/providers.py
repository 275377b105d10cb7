"""Extension points as plain protocols, and how tables are put through them.

A provider is any object with the method named; it is sent to the tasks, so it must
be picklable.  One that fails leaves a status behind, never a failed job.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import suppress


class ImageDecoder(Protocol):
    """Encoded content to an array of height, width and three colours."""

    def decode(self, content: bytes) -> np.ndarray: ...


class FaceDetector(Protocol):
    """An image to boxes ``x, y, width, height, score``, all within 0 and 1."""

    def detect(self, image: np.ndarray) -> list[tuple[float, float, float, float, float]]: ...


class RecommendationProvider(Protocol):
    """Evidence columns to a label."""

    def recommend(self) -> Column: ...


class EmbeddingProvider(Protocol):
    """E5: texts to vectors of ``dimension`` under one ``key``; vectors of different keys are never compared."""

    key: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class EditAdapter(Protocol):
    """A manifest to files by name."""

    def render(self, manifest: str) -> dict[str, str]: ...


class DestinationLayout(Protocol):
    """Where an entry goes, relative to the destination."""

    def place(self) -> Column: ...


class AvailableSpace(Protocol):
    """Free bytes below a mounted path."""

    def free(self, path: str) -> int: ...


class IntegrityVerifier(Protocol):
    """Whether a file has the expected digest."""

    def verify(self, path: str, digest: str) -> bool: ...


class MountedSpace:
    """The free bytes that the operating system reports."""

    def free(self, path: str) -> int:
        return shutil.disk_usage(path).free


class DigestVerifier:
    """Compares with the SHA-256 of the file's content, read in blocks."""

    def verify(self, path: str, digest: str) -> bool:
        import hashlib

        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.hexdigest() == digest


_FACES = "asset_id string, status string, provider int, faces array<struct<x: double, y: double, width: double, height: double, score: double>>"


def detect_faces(images: DataFrame, decoder: ImageDecoder, detectors: list[FaceDetector]) -> DataFrame:
    """The faces of each image (``asset_id, content``) by the first detector that works, after suppression of overlaps.

    ``status`` is ``ready`` (also without faces), ``corrupt`` for what can't be
    decoded, ``unavailable`` where every detector failed; ``provider`` is the place
    of the one that worked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for asset, content in zip(pdf["asset_id"], pdf["content"]):
                try:
                    image = decoder.decode(bytes(content))
                except Exception:
                    image = None
                if image is None:
                    rows.append((asset, "corrupt", None, []))
                    continue
                for place, d in enumerate(detectors):
                    try:
                        boxes = [tuple(map(float, b)) for b in d.detect(image)]
                    except Exception:
                        continue
                    kept = [boxes[i] for i in suppress(boxes)]
                    rows.append((asset, "ready", place, [dict(zip(("x", "y", "width", "height", "score"), b)) for b in kept]))
                    break
                else:
                    rows.append((asset, "unavailable", None, []))
            yield pd.DataFrame(rows, columns=["asset_id", "status", "provider", "faces"]).astype({"provider": "Int32"})

    return images.select("asset_id", "content").mapInPandas(run, _FACES)


def embed_texts(rows: DataFrame, provider: EmbeddingProvider, text: str = "text") -> DataFrame:
    """E5: ``rows`` with ``compatibility_key`` and ``vector`` (unit length); null for blank texts and unusable vectors."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        use = t.map(lambda x: x is not None and bool(x.strip()))
        out: list[list[float] | None] = [None] * len(t)
        if use.any():
            got = np.asarray(provider.embed(t[use].tolist()), dtype=np.float64)
            norm = np.linalg.norm(got, axis=1)
            for i, v, n in zip(np.nonzero(use.to_numpy())[0], got, norm):
                if got.shape[1] == provider.dimension and np.isfinite(n) and n > 0:
                    out[i] = (v / n).tolist()
        return pd.Series(out, dtype=object)

    return rows.withColumns({"compatibility_key": F.lit(provider.key), "vector": run(F.col(text))})


def render_handoffs(manifests: DataFrame, adapter: EditAdapter) -> DataFrame:
    """``handoff_id, name, content`` of the files that the adapter makes of each manifest."""
    render = F.udf(adapter.render, "map<string, string>")
    return manifests.select("handoff_id", F.explode(render("manifest")).alias("name", "content"))


def place_entries(entries: DataFrame, layout: DestinationLayout, space: AvailableSpace, root: str, size: str = "byte_size") -> DataFrame:
    """``entries`` with their ``relative_path``; refused as a whole where the destination hasn't room for all of them."""
    need = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if need > space.free(root):
        raise OSError(f"{need} bytes don't fit below {root}")
    return entries.withColumn("relative_path", layout.place())


def verify_files(entries: DataFrame, verifier: IntegrityVerifier, root: str) -> DataFrame:
    """``relative_path, digest, state``: ``verified``, ``mismatch`` or ``missing`` for what can't be read."""

    @F.udf("string")
    def state(rel: str, digest: str) -> str:
        try:
            return "verified" if verifier.verify(os.path.join(root, rel), digest) else "mismatch"
        except OSError:
            return "missing"

    return entries.select("relative_path", "digest", state("relative_path", "digest").alias("state"))
