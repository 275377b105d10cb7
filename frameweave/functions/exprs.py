"""Scalar operators as column expressions: names, paths, dates, hashes, vectors (F*, D*, H*, P10-P16).

Everything here is a composition of built-in functions, except the NFC step of
file-name matching, which Spark has no built-in for.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Device names that can't be file names on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
# Media class of file extensions.
EXTENSIONS = {
    "raw": ("arw", "cr2", "cr3", "dng", "nef", "orf", "raf", "rw2", "pef", "srw", "3fr"),
    "jpeg": ("jpg", "jpeg"),
    "heif": ("heic", "heif"),
    "png": ("png",),
    "tiff": ("tif", "tiff"),
    "video": ("mov", "mp4", "m4v", "avi", "mxf"),
    "audio": ("wav", "mp3", "m4a", "aac", "aif", "aiff"),
    "sidecar": ("xmp", "srt", "xml", "json"),
}
PHOTOS = ("raw", "jpeg", "heif", "png", "tiff")
# Endings that editing tools add to a file's stem.
EDIT_SUFFIXES = ("edited", "edit", "retouch", "final")


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# names and paths -----------------------------------------------------------


def normalize_space(s: str | Column) -> Column:
    """lower case, runs of white space as one blank, no blanks at the ends."""
    return F.lower(F.trim(F.regexp_replace(c(s), r"\s+", " ")))


def sanitize_component(s: str | Column, most: int = 120) -> Column:
    """F2: a safe file-name component; blank becomes ``Untitled``, device names (up to the first dot) get a leading underscore.

    Blanks, then dots, then blanks again are trimmed, once each.
    """
    t = F.regexp_replace(F.coalesce(c(s), F.lit("")), r'[\x00-\x1f\x7f-\x9f/\\:*?"<>|]', "_")
    for ends in (r"(?U)^\s+|\s+$", r"^\.+|\.+$", r"(?U)^\s+|\s+$"):
        t = F.regexp_replace(t, ends, "")
    t = F.regexp_replace(t, r"_{2,}", "_")
    t = F.when(t == "", F.lit("Untitled")).otherwise(t)
    t = F.when(F.upper(F.substring_index(t, ".", 1)).isin(list(RESERVED)), F.concat(F.lit("_"), t)).otherwise(t)
    return F.substring(t, 1, most)


def cache_component(s: str | Column, most: int = 120) -> Column:
    """letters, digits, dash and underscore only."""
    return F.substring(F.regexp_replace(c(s), r"[^A-Za-z0-9_-]", ""), 1, most)


def ingest_component(s: str | Column) -> Column:
    """other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(c(s), r"[^A-Za-z0-9._-]", "_")


def file_name(path: str | Column) -> Column:
    return F.substring_index(F.replace(c(path), F.lit("\\"), F.lit("/")), "/", -1)


def stem(name: str | Column) -> Column:
    """the name up to its last dot, the whole name if there is none or it is the first character."""
    return F.when(c(name).rlike(r"^.+\.[^.]*$"), F.regexp_extract(c(name), r"^(.+)\.[^.]*$", 1)).otherwise(c(name))


def extension(name: str | Column) -> Column:
    """lower-case text behind the last dot, empty if there is none."""
    return F.lower(F.regexp_extract(c(name), r"^.+\.([^.]*)$", 1))


def media_class(path: str | Column) -> Column:
    """P10: the class of a file by its extension; ``unknown`` for all others."""
    ext = extension(file_name(path))
    return reduce(lambda w, kv: w.when(ext.isin(list(kv[1])), F.lit(kv[0])), EXTENSIONS.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("unknown"))


def safe_relative_path(path: str | Column) -> Column:
    """True for a relative path without empty, dot or parent parts, drive prefix or NUL; null is not safe."""
    p = F.replace(c(path), F.lit("\\"), F.lit("/"))
    bad = (p == "") | p.contains("\x00") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.coalesce(~bad, F.lit(False))


def render_template(template: str, tokens: dict[str, Column]) -> Column:
    """text with ``{token}`` parts; unknown or unbalanced ones are refused before anything runs."""
    import re

    parts = re.split(r"(\{[^{}]*\})", template)
    if any("{" in p or "}" in p for p in parts[::2]):
        raise ValueError("unbalanced braces in the template")
    unknown = [p for p in parts[1::2] if p[1:-1] not in tokens]
    if unknown:
        raise ValueError(f"unknown tokens: {unknown}")
    return F.concat(*[tokens[p[1:-1]] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def moment_label(human: str | Column, suggested: str | Column, ordinal: str | Column) -> Column:
    """human label, else the suggested one, else a numbered one."""
    pick = F.coalesce(c(human), c(suggested))
    return F.when(pick.isNotNull(), sanitize_component(pick)).otherwise(F.format_string("Moment_%03d", c(ordinal) + 1))


def moment_folder(human: str | Column, suggested: str | Column, ordinal: str | Column) -> Column:
    return F.concat(F.format_string("%02d", c(ordinal) + 1), F.lit("_"), moment_label(human, suggested, ordinal))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """canonical composition, null for null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def match_path(path: str | Column) -> Column:
    return F.lower(F.replace(c(path), F.lit("\\"), F.lit("/")))


def match_stem(name: str | Column) -> Column:
    """the stem's letters and digits, lower case, without one editing suffix."""
    s = F.regexp_replace(F.lower(stem(name)), r"[^\p{L}\p{N}]", "")
    return F.regexp_replace(s, f"^(.+?)({'|'.join(EDIT_SUFFIXES)})$", "$1")


def csv_cell(s: str | Column) -> Column:
    """F8: no cell that a spreadsheet would run as a formula, quoted where needed."""
    t = F.regexp_replace(F.coalesce(c(s), F.lit("")), r"^([=+\-@])", "'$1")
    return F.when(t.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def html_text(s: str | Column) -> Column:
    """F8: text with the five reserved characters as entities."""
    t = F.coalesce(c(s), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# dates ---------------------------------------------------------------------

_CAMERA = r"^\s*(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})(?:\s*\.(\d{1,9}))?(?:\s*([+-]\d{2}:\d{2}))?\s*$"


def camera_wall(s: str | Column) -> Column:
    """The wall clock of a camera's date text as TIMESTAMP_NTZ, null if it is none."""
    p = lambda i: F.regexp_extract(c(s), _CAMERA, i)
    text = F.concat(p(1), F.lit("-"), p(2), F.lit("-"), p(3), F.lit(" "), p(4), F.lit("."), F.rpad(F.substring(p(5), 1, 6), 6, "0"))
    return F.when(c(s).rlike(_CAMERA), text.try_cast("timestamp_ntz"))


def camera_offset(s: str | Column) -> Column:
    """The offset written behind a camera's date, ``unknown`` if none is (never UTC)."""
    o = F.regexp_extract(c(s), _CAMERA, 6)
    return F.when(o == "", F.lit("unknown")).otherwise(o)


def platform_instant(s: str | Column) -> Column:
    """An instant from RFC-3339 text or ``date time [fraction] offset``; null without an offset."""
    shape = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2}(?:\.\d+)?) ?([Zz]|[+-]\d{2}:?\d{2})$"
    zone = F.regexp_replace(F.upper(F.regexp_extract(c(s), shape, 3)), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(c(s).rlike(shape), F.concat_ws(" ", F.regexp_extract(c(s), shape, 1), F.concat(F.regexp_extract(c(s), shape, 2), zone)).try_cast("timestamp"))


def bucket(number: str | Column, width: int) -> Column:
    """D3: floor division, also below zero."""
    return F.floor(c(number) / F.lit(width)).cast("bigint")


def date_token(s: str | Column) -> Column:
    """``yyyymmdd`` of the first ten characters, ``UnknownDate`` for null."""
    return F.coalesce(F.replace(F.substring(c(s), 1, 10), F.lit("-"), F.lit("")), F.lit("UnknownDate"))


# hashes, vectors, numbers ---------------------------------------------------


def digest(*parts: str | Column) -> Column:
    """H2: SHA-256 over the parts, separated so that no two lists of parts look alike; null parts are kept apart from empty ones."""
    kept = [F.coalesce(F.concat(F.lit("="), c(p).cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat_ws("\x00", *kept), 256)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; NaN becomes the lower bound, null stays null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def dot(a: str | Column, b: str | Column) -> Column:
    """H4: sum of products in double."""
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def valid_vector(a: str | Column) -> Column:
    """Non-empty, all finite, norm above zero; false for null."""
    ok = F.forall(c(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(a) > 0)
    return F.coalesce((F.size(c(a)) > 0) & ok, F.lit(False))


def normalize(a: str | Column) -> Column:
    """H3: unit length; null for invalid vectors."""
    n = norm(a)
    return F.when(valid_vector(a), F.transform(c(a), lambda x: x.cast("double") / n))


def cosine(a: str | Column, b: str | Column) -> Column:
    """H4: cosine in double; null for invalid vectors or unequal lengths."""
    return F.when(valid_vector(a) & valid_vector(b) & (F.size(c(a)) == F.size(c(b))), dot(a, b) / (norm(a) * norm(b)))


def flip_one_bit(signature: str | Column, bits: int = 16) -> Column:
    """H7: the signature and its ``bits`` neighbours at one bit's distance."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: c(signature).bitwiseXOR(F.call_function("shiftleft", F.lit(1), i.cast("int"))))
    return F.concat(F.array(c(signature)), flips)


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def softmax(logits: list[Column], temperature: Column | float = 1.0) -> list[Column]:
    """Shifted by the largest logit."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.greatest(*logits)
    e = [F.exp((x - top) / t) for x in logits]
    whole = reduce(lambda a, b: a + b, e)
    return [x / whole for x in e]


# evidence ladders -----------------------------------------------------------


def sharpness_band(score: str | Column) -> Column:
    """By 62, 38 and 20; null for null."""
    s = c(score)
    return F.when(s >= 62, "excellent").when(s >= 38, "good").when(s >= 20, "review").when(s < 20, "low_detail")


def blur_level(sharpness: str | Column, directional_ratio: str | Column) -> Column:
    """Low from 42; high and moderate need directional evidence; everything else is uncertain."""
    s, d = c(sharpness), c(directional_ratio)
    return F.when(s >= 42, "low").when((d < 0.32) & (s < 20), "high").when((d < 0.52) & (s < 34), "moderate").when(s.isNotNull(), "uncertain")


def quality_band(score: str | Column, highlights: str | Column, shadows: str | Column) -> Column:
    """Strong from 76 with under 5 % highlights and 12 % shadows clipped, then 54 and 30; null for null."""
    s = c(score)
    return F.when((s >= 76) & (c(highlights) < 5) & (c(shadows) < 12), "strong").when(s >= 54, "good").when(s >= 30, "review").when(s < 30, "technical_issue")


def suggestion_confidence(technical: str | Column, grouped: str | Column, closed_eyes: str | Column) -> Column:
    """Technical confidence, less for ungrouped frames and closed eyes, within [0.25, 0.92]."""
    base = c(technical) * F.when(c(grouped), 0.92).otherwise(0.78) * F.when(c(closed_eyes), 0.88).otherwise(1.0)
    return clamp(base, 0.25, 0.92)
