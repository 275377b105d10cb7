"""Similarity of fingerprints as column expressions (H1, H4, H5) and the pair gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = (0.60, 0.15, 0.25)  # hash, colour, embedding


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_bits(hash_hex: str | Column) -> Column:
    """A 64-bit hash of 16 hex digits as BIGINT, null for anything else."""
    h = _c(hash_hex)
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("bigint"))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two hex hashes; 64 where either is invalid."""
    return F.coalesce(F.bit_count(hex_bits(a).bitwiseXOR(hex_bits(b))), F.lit(64))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("bigint"))


def color_similarity(a: str | Column, b: str | Column) -> Column:
    """1 - L1/(n*255) of two histograms; 0 for null or empty ones or unequal lengths."""
    a, b = _c(a), _c(b)
    n = F.size(a)
    l1 = _sum(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0)).cast("int") - F.coalesce(y, F.lit(0)).cast("int"))))
    return F.when((n > 0) & (n == F.size(b)), 1.0 - l1.cast("double") / (n * 255.0)).otherwise(F.lit(0.0))


def _times(x: Column, y: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("int") * F.coalesce(y, F.lit(0)).cast("int")


def square(a: str | Column) -> Column:
    """The sum of squares of an integer vector, to be worked out once for a row that takes part in many pairs."""
    return _sum(F.transform(_c(a), lambda x: _times(x, x)))


def cosine_unit(a: str | Column, b: str | Column, aa: Column | None = None, bb: Column | None = None) -> Column:
    """(cosine + 1) / 2 of two integer vectors, within [0, 1]; 0 for null or empty ones or unequal lengths, 0.5 for an all-zero one.

    ``aa`` and ``bb`` are their :func:`square` if known.
    """
    a, b = _c(a), _c(b)
    dot, aa, bb = _sum(F.zip_with(a, b, _times)), square(a) if aa is None else aa, square(b) if bb is None else bb
    cos = dot.cast("double") / (F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double")))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1.0) / 2.0))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.when((aa > 0) & (bb > 0), unit).otherwise(F.lit(0.5))).otherwise(F.lit(0.0))


def visual_similarity(distance: Column, color: Column, embedding: Column) -> Column:
    """Weighted mean of hash, colour and embedding similarity, within [0, 1]."""
    h, c, e = WEIGHTS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - distance / 64.0) * h + color * c + embedding * e))
