"""Raster analysis on arrays: decode, hashes, descriptors, technical metrics, overlap suppression.

Pixels are not expressible in built-in functions, so these run in Arrow batches;
each image gives one row with a status, and a broken image never fails a batch.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_EDGE = 512


def decode(data: bytes) -> np.ndarray:
    """Binary PPM (P6) or an uncompressed 24/32-bit BMP as (height, width, 3) bytes; ValueError otherwise."""
    if data[:2] == b"P6":
        parts, at = [], 2
        while len(parts) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at) + 1
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("bad header")
            parts.append(int(data[at:end]))
            at = end
        w, h, top = parts
        body = data[at + 1 :]
        if top != 255 or w < 1 or h < 1 or len(body) < w * h * 3:
            raise ValueError("bad size")
        return np.frombuffer(body[: w * h * 3], np.uint8).reshape(h, w, 3)
    if data[:2] == b"BM" and len(data) > 54:
        start, w, h = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18)
        depth, packed = struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
        if packed or depth not in (24, 32) or w < 1 or h == 0:
            raise ValueError("unsupported bitmap")
        row = (w * depth // 8 + 3) // 4 * 4
        if len(data) < start + row * abs(h):
            raise ValueError("cut short")
        px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
        return (px[::-1] if h > 0 else px)[:, :, 2::-1]
    raise ValueError("unknown format")


def _sample(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.minimum((np.arange(height) * rgb.shape[0]) // height, rgb.shape[0] - 1)
    x = np.minimum((np.arange(width) * rgb.shape[1]) // width, rgb.shape[1] - 1)
    return rgb[y][:, x]


def luminance(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    return _sample(rgb, width, height).astype(float) @ np.array([0.2126, 0.7152, 0.0722]) / 255.0


def _hex(bits: np.ndarray) -> str:
    return f"{sum(1 << i for i in np.nonzero(bits.ravel())[0].tolist()):016x}"


def perceptual_hash(rgb: np.ndarray) -> str:
    """H8: 8 x 8 low cosine frequencies of a 32 x 32 sample against their median; the first bit is unused."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(8)[:, None] / 64)
    coeff = (basis @ luminance(rgb, 32, 32) @ basis.T).ravel()
    bits = coeff >= np.sort(coeff[1:])[63 // 2]
    bits[0] = False
    return _hex(bits)


def difference_hash(rgb: np.ndarray) -> str:
    """H8: falling or level brightness between neighbours of a 9 x 8 sample."""
    v = luminance(rgb, 9, 8)
    return _hex(v[:, :-1] >= v[:, 1:])


def color_signature(rgb: np.ndarray) -> list[int]:
    """4 x 4 x 4 colour bins of a 64 x 64 sample, scaled to 255."""
    s = _sample(rgb, 64, 64).astype(int) // 64
    return (np.bincount(((s[..., 0] << 4) | (s[..., 1] << 2) | s[..., 2]).ravel(), minlength=64) * 255 // 4096).tolist()


def luminance_descriptor(rgb: np.ndarray) -> list[int]:
    """H9: 8 x 8 brightness around its mean, halves away from zero, within 127."""
    v = luminance(rgb, 8, 8).ravel()
    d = (v - v.mean()) * 254.0
    return np.clip(np.sign(d) * np.floor(np.abs(d) + 0.5), -127, 127).astype(int).tolist()


def technical(rgb: np.ndarray) -> dict[str, float | str]:
    """Sharpness, direction of blur, clipping and their score, on at most 512 pixels an edge."""
    h, w = rgb.shape[:2]
    k = min(MOST_EDGE / max(w, h), 1.0)
    w, h = max(1, round(w * k)), max(1, round(h * k))
    px, v = _sample(rgb, w, h), luminance(rgb, w, h)
    if w < 3 or h < 3:
        lap = edge = local = 0.0
        ratio = 1.0
    else:
        c = v[1:-1, 1:-1]
        second = 4 * c - v[1:-1, :-2] - v[1:-1, 2:] - v[:-2, 1:-1] - v[2:, 1:-1]
        gx, gy = v[1:-1, 2:] - v[1:-1, :-2], v[2:, 1:-1] - v[:-2, 1:-1]
        lap, edge, local = second.var() * 10_000, np.hypot(gx, gy).mean() * 100, np.abs(second).mean() * 100
        a, b = np.abs(gx).sum(), np.abs(gy).sum()
        ratio = min(a, b) / max(a, b, np.finfo(float).eps)
    sharp = float(np.clip(np.sqrt(lap) * 2.5 + edge * 0.45 + local * 1.25, 0, 100))
    high, low, channel = (v >= 0.98).mean() * 100, (v <= 0.02).mean() * 100, ((px <= 2) | (px >= 253)).mean() * 100
    blur = "low" if sharp >= 42 else "high" if ratio < 0.32 and sharp < 20 else "moderate" if ratio < 0.52 and sharp < 34 else "uncertain"
    penalty = min(max(high - 3, 0) * 1.7 + max(low - 8, 0) * 0.7 + max(channel - 5, 0) * 0.45, 52) + {"high": 28, "moderate": 13}.get(blur, 8 if blur == "uncertain" and sharp < 18 else 0)
    return {"sharpness": sharp, "directional_ratio": float(ratio), "blur_level": blur, "highlight_percent": float(high), "shadow_percent": float(low), "channel_percent": float(channel), "score": float(np.clip(sharp * 0.72 + 28 - penalty, 0, 100)), "confidence": 0.82 if min(w, h) >= 128 else 0.55}


def suppress(boxes: list[tuple[float, float, float, float, float]], overlap: float = 0.3, least: float = 0.7, least_area: float = 0.002) -> list[int]:
    """Indexes of the boxes (x, y, w, h, confidence) kept, the surest first, none overlapping a kept one by more than ``overlap``."""
    order = sorted((i for i, b in enumerate(boxes) if b[4] >= least and b[2] * b[3] >= least_area), key=lambda i: (-boxes[i][4], i))
    kept: list[int] = []
    for i in order:
        x, y, w, h, _ = boxes[i]
        for j in kept:
            a, b, c, d, _ = boxes[j]
            inter = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            if inter / (w * h + c * d - inter) > overlap:
                break
        else:
            kept.append(i)
    return kept


_OUT = (
    "path string, status string, error string, width int, height int, perceptual_hash string, difference_hash string, color_signature array<smallint>, embedding array<tinyint>,"
    " bucket_keys array<string>, sharpness double, directional_ratio double, blur_level string, highlight_percent double, shadow_percent double, channel_percent double, score double, confidence double"
)


def analyze(images: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """One row for each ``path, content`` with its evidence, or the error that kept it from being read."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                row: dict = dict.fromkeys(names) | {"path": path}
                try:
                    rgb = decoder(bytes(content))
                    h = perceptual_hash(rgb)
                    row |= {"status": "ready", "width": rgb.shape[1], "height": rgb.shape[0], "perceptual_hash": h, "difference_hash": difference_hash(rgb), "color_signature": color_signature(rgb), "embedding": luminance_descriptor(rgb), "bucket_keys": [f"phash:{b}:{int(h, 16) >> 16 * b & 0xFFFF:04x}" for b in range(4)]} | technical(rgb)
                except (ValueError, TypeError, struct.error) as e:
                    row |= {"status": "corrupt", "error": str(e)[:200]}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})

    return images.select("path", "content").mapInPandas(run, _OUT)
