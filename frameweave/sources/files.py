"""Scans of folders and headers, the vector-index store, volumes."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import extension, file_name, media_class, safe_relative_path
from ..session import cut, file_system, partitions

SAMPLE, WHOLE_MOST, HEAD_MOST = 65_536, 1_048_576, 16 * 1_048_576


def scan_media(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Every file below ``root``: relative path, name, extension, class, size, time and whether its path is safe."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:(//)?", "")
    rel = F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(file_name("path"))
    out = files.withColumn("relative_path", rel).select(
        "path", "relative_path", file_name("relative_path").alias("display_name"), extension(file_name("relative_path")).alias("extension"), media_class("relative_path").alias("media_class"),
        F.col("length").alias("byte_size"), "modificationTime", safe_relative_path("relative_path").alias("safe"), *(["content"] if content else []),
    )
    return out


def with_fingerprints(scanned: DataFrame) -> DataFrame:
    """A fast fingerprint of size, extension and both ends of the content; the whole digest only of small files."""
    tail = F.when(F.col("byte_size") > 2 * SAMPLE, F.expr(f"substring(content, -{SAMPLE}, {SAMPLE})")).otherwise(F.expr(f"substring(content, {SAMPLE + 1}, {SAMPLE})"))
    head = F.concat(F.encode(F.concat_ws("\x00", F.lit("fast-1"), F.col("byte_size").cast("string"), "extension"), "utf-8"), F.expr(f"substring(content, 1, {SAMPLE})"))
    return scanned.withColumns({"fast_fingerprint": F.sha2(F.concat(head, tail), 256), "content_hash": F.when(F.col("byte_size") <= WHOLE_MOST, F.sha2("content", 256))})


_ENTRY = "relative_path string, kind string, byte_size bigint, modified_us bigint, warning string"


def walk_media(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a mounted ``root`` and a warning for everything that was passed over.

    ``relative_path, kind`` (``file``, or of a warning ``symlink``, ``special``,
    ``unreadable``, ``unsafe``), ``byte_size, modified_us, warning``, and for files
    ``display_name, extension, media_class``.  Folders are listed level by level in
    tasks; links aren't followed; a folder that can't be read is a warning, but a
    missing root an error.
    """
    import os

    if not os.path.isdir(root):
        raise FileNotFoundError(root)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for folder in pdf["relative_path"]:
                try:
                    found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
                except OSError as e:
                    rows.append((folder, "unreadable", None, None, f"cannot read directory: {e.strerror}"))
                    continue
                for e in found:
                    rel = f"{folder}/{e.name}" if folder else e.name
                    try:
                        rel.encode()
                        if e.is_symlink():
                            rows.append((rel, "symlink", None, None, "symbolic link skipped"))
                        elif e.is_dir(follow_symlinks=False):
                            rows.append((rel, "folder", None, None, None))
                        elif e.is_file(follow_symlinks=False):
                            info = e.stat(follow_symlinks=False)
                            rows.append((rel, "file", info.st_size, info.st_mtime_ns // 1000, None))
                        else:
                            rows.append((rel, "special", None, None, "special file skipped"))
                    except UnicodeEncodeError:
                        rows.append((rel.encode(errors="replace").decode(), "unsafe", None, None, "unsafe path skipped"))
                    except OSError as x:
                        rows.append((rel, "unreadable", None, None, f"cannot inspect entry: {x.strerror}"))
            yield pd.DataFrame(rows, columns=["relative_path", "kind", "byte_size", "modified_us", "warning"]).astype({"byte_size": "Int64", "modified_us": "Int64"})

    folders, out = spark.createDataFrame([("",)], "relative_path string"), None
    while True:
        level = cut(folders.repartition(partitions(spark)).mapInPandas(entries, _ENTRY))
        rest = level.where("kind != 'folder'")
        out = rest if out is None else out.unionByName(rest)
        folders = level.where("kind = 'folder'").select("relative_path")
        if folders.isEmpty():
            break
    name, is_file = file_name("relative_path"), F.col("kind") == "file"
    return out.withColumns({"display_name": F.when(is_file, name), "extension": F.when(is_file, extension(name)), "media_class": F.when(is_file, media_class("relative_path"))})


def fingerprint_files(walked: DataFrame, root: str) -> DataFrame:
    """``relative_path, fast_fingerprint, content_hash, warning`` of the walked files, which are opened in tasks.

    At most both ends of 64 KiB are read of a file; only one of up to 1 MiB is read
    whole and has a content hash.  The digest equals that of
    :func:`with_fingerprints`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        for pdf in batches:
            rows = []
            for rel, ext in zip(pdf["relative_path"], pdf["extension"]):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        size = os.fstat(f.fileno()).st_size
                        whole = f.read(WHOLE_MOST) if size <= WHOLE_MOST else None
                        if whole is None:
                            head = f.read(SAMPLE)
                            f.seek(-SAMPLE, os.SEEK_END)
                            ends = head + f.read(SAMPLE)
                        else:
                            ends = whole[:SAMPLE] + (whole[-SAMPLE:] if size > 2 * SAMPLE else whole[SAMPLE : 2 * SAMPLE])
                    fast = hashlib.sha256(b"\x00".join([b"fast-1", str(size).encode(), ext.encode()]) + ends).hexdigest()
                    rows.append((rel, fast, hashlib.sha256(whole).hexdigest() if whole is not None else None, None))
                except OSError as e:
                    rows.append((rel, None, None, f"cannot fingerprint: {e.strerror}"))
            yield pd.DataFrame(rows, columns=["relative_path", "fast_fingerprint", "content_hash", "warning"])

    return walked.where("kind = 'file'").select("relative_path", "extension").mapInPandas(run, "relative_path string, fast_fingerprint string, content_hash string, warning string")


def wav_header(data: bytes) -> dict[str, int] | None:
    """Sample rate, depth, channels and duration of a RIFF file, None for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt, size = 12, None, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            _, channels, rate, per_s, _, depth = struct.unpack_from("<HHIIHH", data, at + 8)
            fmt = (channels, rate, per_s, depth)
        elif name == b"data":
            size = n
        at += 8 + n + (n & 1)
    if fmt is None or not fmt[2]:
        return None
    return {"channels": fmt[0], "sample_rate": fmt[1], "bit_depth": fmt[3], "duration_ms": (size or 0) * 1000 // fmt[2]}


# EXIF tags of the three capture times, their fractions and offsets.
EXIF_TIMES = {0x9003: ("exif_datetime_original", 0x9291, 0x9011), 0x9004: ("exif_datetime_digitized", 0x9292, 0x9012), 0x0132: ("exif_create_date", 0x9290, 0x9010)}


def exif_times(data: bytes) -> list[dict[str, str]]:
    """The capture-time candidates of a TIFF-structured EXIF block (also inside a JPEG); bounded read."""
    data = data[:HEAD_MOST]
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\x00\x00")
        if at < 0:
            return []
        data = data[at + 6 :]
    if data[:4] not in (b"II*\x00", b"MM\x00*"):
        return []
    e = "<" if data[:2] == b"II" else ">"
    found: dict[int, str] = {}

    def walk(at: int, depth: int) -> None:
        if depth > 3 or at + 2 > len(data):
            return
        for i in range(struct.unpack_from(e + "H", data, at)[0]):
            p = at + 2 + 12 * i
            if p + 12 > len(data):
                return
            tag, kind, n, value = struct.unpack_from(e + "HHII", data, p)
            if tag == 0x8769:
                walk(value, depth + 1)
            elif kind == 2 and n < 256:
                raw = data[p + 8 : p + 8 + n] if n <= 4 else data[value : value + n]
                found[tag] = raw.split(b"\x00")[0].decode("ascii", "replace").strip()

    walk(struct.unpack_from(e + "I", data, 4)[0], 0)
    out = []
    for tag, (source, fraction, offset) in EXIF_TIMES.items():
        if found.get(tag):
            text = found[tag] + (f".{found[fraction]}" if found.get(fraction, "").isdigit() else "")
            out.append({"raw": text, "local": text.replace(":", "-", 2).replace(" ", "T"), "timezone": found.get(offset) or "unknown", "source": source, "confidence": "high"})
    return out


def media_headers(scanned: DataFrame) -> DataFrame:
    """Header evidence of each scanned file (``path, content``): a status, WAV properties and capture times."""
    out = "path string, status string, sample_rate int, bit_depth int, channels int, duration_ms bigint, candidates array<struct<raw: string, local: string, timezone: string, source: string, confidence: string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content or b"")
                try:
                    wav, times = wav_header(data), exif_times(data)
                    status = "empty" if not data else "ready"
                except (struct.error, ValueError):
                    wav, times, status = None, [], "corrupt"
                wav = wav or {}
                rows.append((path, status, wav.get("sample_rate"), wav.get("bit_depth"), wav.get("channels"), wav.get("duration_ms"), times))
            yield pd.DataFrame(rows, columns=["path", "status", "sample_rate", "bit_depth", "channels", "duration_ms", "candidates"]).astype({"sample_rate": "Int32", "bit_depth": "Int32", "channels": "Int32", "duration_ms": "Int64"})

    return scanned.select("path", "content").mapInPandas(run, out)


def _index_path(path: str, project_id: str, model_key: str) -> str:
    part = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32]
    return f"{path.rstrip('/')}/{part(project_id)}/{part(model_key)}"


def _checksum(buckets: DataFrame) -> str:
    """A digest of all rows in any order: their number and two sums of their hashes."""
    columns = sorted(buckets.columns)
    h = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    r = buckets.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(x.cast("decimal(20,0)")), F.lit(0)) for x in h]).first()
    return hashlib.sha256("/".join(map(str, r)).encode()).hexdigest()


def write_vector_index(signatures: DataFrame, path: str, project_id: str, model_key: str, dimension: int, version: str = "lsh-1") -> None:
    """The buckets of one project and model as Parquet, with what they were built for and their checksum.

    They are written beside their place and renamed into it when complete, so a
    reader finds the old index, none or the new one; other projects' and models'
    indexes aren't touched.
    """
    spark = signatures.sparkSession
    at = _index_path(path, project_id, model_key)
    new = f"{at}.{uuid.uuid4().hex}"
    signatures.write.parquet(f"{new}/buckets")
    meta = [(project_id, model_key, dimension, version, _checksum(spark.read.parquet(f"{new}/buckets")))]
    spark.createDataFrame(meta, "project_id string, model_key string, dimension int, version string, checksum string").coalesce(1).write.json(f"{new}/meta")
    target, fs = file_system(spark, at)
    fs.delete(target, True)
    if not fs.rename(file_system(spark, new)[0], target):
        raise OSError(f"the index could not be renamed to {at}")


def load_vector_index(spark: SparkSession, path: str, project_id: str, model_key: str, dimension: int, version: str = "lsh-1") -> DataFrame | None:
    """The buckets, None if there is no index; ValueError if it is damaged or was built for something else (rebuild it)."""
    at, fs = file_system(spark, _index_path(path, project_id, model_key))
    if not fs.exists(at):
        return None
    try:
        meta = spark.read.json(f"{at}/meta").first().asDict()
        buckets = spark.read.parquet(f"{at}/buckets")
        wanted = {"project_id": project_id, "model_key": model_key, "dimension": dimension, "version": version}
        if {k: meta[k] for k in wanted} != wanted:
            raise ValueError("the index was built for another project, model, length or version")
        sound = _checksum(buckets) == meta["checksum"]
    except (AnalysisException, KeyError, AttributeError) as e:
        raise ValueError("the index is damaged") from e
    if not sound:
        raise ValueError("the index doesn't match its checksum")
    return buckets


def volumes(observed: DataFrame) -> DataFrame:
    """The latest observation of each volume with its ``identity`` (its file system's, else its id) and whether it is ``online``.

    ``observed``: ``volume_id, filesystem_identity, mount_root, label,
    capacity_bytes, available_bytes, observed_at``; a volume without a mount root
    is offline.  Rows without an id are left out.
    """
    last = observed.where("volume_id is not null").groupBy("volume_id").agg(F.max(F.struct("observed_at", *[c for c in observed.columns if c not in ("volume_id", "observed_at")])).alias("v"))
    return last.select("volume_id", "v.*").withColumns({"identity": F.coalesce(F.when(F.trim("filesystem_identity") != "", F.col("filesystem_identity")), F.col("volume_id")), "online": F.col("mount_root").isNotNull()})
