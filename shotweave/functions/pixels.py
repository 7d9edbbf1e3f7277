"""Statistics of raw RGB frames: colour histogram, perceptual hash, sharpness, brightness, structural similarity.

Frames come as bytes of height x width x 3; whatever decodes videos writes them so. The work is vectorised inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = (8, 4, 4)
HASH, SCALE = 8, 4


def split_frames(files: DataFrame, width: int, height: int) -> DataFrame:
    """Frames of files that hold them end to end (as read by ``binaryFile``): path, frame, data. A rest is dropped."""
    size = width * height * 3
    n = F.floor(F.length("content") / size).cast("int")
    rows = files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    return rows.select("path", F.col("frame").cast("long").alias("frame"), F.substring("content", F.col("frame") * size + 1, F.lit(size)).alias("data"))


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_weights(n: int, to: int) -> np.ndarray:
    """How much each of n cells gives to each of fewer equal cells that cover them."""
    edges, cells = np.arange(to + 1) * n / to, np.arange(n)
    share = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(share, 0) * to / n


def cosines(n: int) -> np.ndarray:
    """The orthonormal discrete cosine transform as a matrix."""
    k, i = np.arange(n)[:, None], np.arange(n)
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def perceptual_hash(picture: np.ndarray) -> int:
    """64 bits: which of the lowest frequencies of a small picture are above their median."""
    n = HASH * SCALE
    small = area_weights(picture.shape[0], n) @ picture @ area_weights(picture.shape[1], n).T
    low = (cosines(n) @ small @ cosines(n).T)[:HASH, :HASH]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def sharpness(picture: np.ndarray) -> float:
    """The variance of the Laplacian, borders mirrored."""
    p = np.pad(picture, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * picture).var())


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Shares of pixels in hue x saturation x value cells."""
    x = rgb.reshape(-1, 3).astype(np.float64) / 255
    top, low = x.max(1), x.min(1)
    d = np.where(top > low, top - low, 1)
    r, g, b = x.T
    h = np.select([top == r, top == g], [(g - b) / d, (b - r) / d + 2], (r - g) / d + 4) / 6 % 1
    h[top == low] = 0
    s = (top - low) / np.where(top > 0, top, 1)
    cell = [np.minimum((v * n).astype(int), n - 1) for v, n in zip((h, s, top), BINS)]
    return np.bincount(np.ravel_multi_index(cell, BINS), minlength=int(np.prod(BINS))) / len(x)


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity with a Gaussian window of 11 x 11, borders mirrored."""
    k = np.exp(-((np.arange(11) - 5.0) ** 2) / (2 * 1.5**2))
    k /= k.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            p = np.pad(x, [(5, 5) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
            x = np.apply_along_axis(np.convolve, axis, p, k, mode="valid")
        return x

    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def frame_stats(frames: DataFrame, width: int, height: int, keys: list[str]) -> DataFrame:
    """keys, phash long, sharpness, brightness (0 to 1), color array<double>. ``frames``: keys and data; a frame of another
    size or none has nulls and, as without a picture, brightness 0.5."""

    def stats(data: bytes | None) -> tuple:
        if data is None or len(data) != width * height * 3:
            return None, None, 0.5, None
        rgb = np.frombuffer(data, np.uint8).reshape(height, width, 3)
        picture = grey(rgb)
        return perceptual_hash(picture), sharpness(picture), float(picture.mean() / 255), histogram(rgb).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            rows = [stats(d) for d in batch["data"]]
            out["phash"] = pd.array([r[0] for r in rows], dtype="Int64")
            for i, c in enumerate(("sharpness", "brightness", "color"), 1):
                out[c] = [r[i] for r in rows]
            yield out

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, "data").mapInPandas(run, f"{kinds}, phash long, sharpness double, brightness double, color array<double>")


def frame_similarity(pairs: DataFrame, width: int, height: int, keys: list[str]) -> DataFrame:
    """Structural similarity of two frames: keys, ssim. ``pairs``: keys, a and b (bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            pictures = [[grey(np.frombuffer(x, np.uint8).reshape(height, width, 3)) for x in batch[c]] for c in ("a", "b")]
            out["ssim"] = [structural_similarity(a, b) for a, b in zip(*pictures)]
            yield out

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "a", "b").mapInPandas(run, f"{kinds}, ssim double")
