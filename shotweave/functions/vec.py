"""Functions of array<double> columns: vectors, histograms, bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def normalized(a: Column | str) -> Column:
    a = _col(a)
    return F.transform(a, lambda x: x / F.greatest(F.sqrt(dot(a, a)), F.lit(EPS)))


def l1_normalized(a: Column | str) -> Column:
    a = _col(a)
    return F.transform(a, lambda x: x / F.greatest(total(a), F.lit(EPS)))


def intersection(a: Column | str, b: Column | str) -> Column:
    """Histogram intersection: the sum of the smaller of each two cells."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.least(x, y)))


def bits_to_long(flags: Column | str) -> Column:
    """Up to 64 booleans as the bits of a long, the first one lowest."""
    indexed = F.transform(_col(flags), lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(indexed, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def bit_agreement(a: Column | str, b: Column | str, n_bits: int = 64) -> Column:
    return 1 - F.bit_count(_col(a).bitwiseXOR(_col(b))) / F.lit(float(n_bits))


def frame_similarities(a: Column | str, b: Column | str) -> Column:
    """array<array<double>>: the cosine of each frame vector of ``a`` with each of ``b`` (both normalised)."""
    b = _col(b)
    return F.transform(_col(a), lambda x: F.transform(b, lambda y: dot(x, y)))


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda i: F.transform(m, lambda row: row[i]))


def best_frame(m: Column) -> Column:
    return F.array_max(F.flatten(m))


def _maxima(m: Column) -> Column:
    return F.transform(m, F.array_max)


def matched(m: Column) -> Column:
    """Every frame meets its best counterpart, both ways; the mean of all."""
    rows, cols = _maxima(m), _maxima(transposed(m))
    return (total(rows) / F.size(rows) + total(cols) / F.size(cols)) / 2


def worst_matched(m: Column) -> Column:
    return F.least(F.array_min(_maxima(m)), F.array_min(_maxima(transposed(m))))


def stability(a: Column | str) -> Column:
    """The least cosine between frames of one shot."""
    return F.array_min(F.flatten(frame_similarities(a, a)))


def rescaled(cosine: Column, floor: float) -> Column:
    """A cosine from [floor, 1] to [0, 1], clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - floor) / (1.0 - floor)))


def blended(clip: Column, color: Column, clip_weight: float, color_weight: float) -> Column:
    if clip_weight + color_weight <= 0:
        raise ValueError("similarity weights must sum to more than 0")
    return (clip * clip_weight + color * color_weight) / (clip_weight + color_weight)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def mean_of(vectors: Column | str) -> Column:
    """Element-wise mean of an array of vectors of one length."""
    v = _col(vectors)
    first = F.transform(v[0], lambda _: F.lit(0.0))
    total_ = F.aggregate(v, first, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total_, lambda x: x / F.size(v))


def structure(a: Column | str, b: Column | str) -> Column:
    """Structural similarity of two vectors as a whole: of their means, and of their deviations with what they share."""
    a, b = _col(a), _col(b)
    n = F.size(a)
    mean_a, mean_b = total(a) / n, total(b) / n
    shared = dot(a, b) / n - mean_a * mean_b
    spread = dot(a, a) / n - mean_a * mean_a + dot(b, b) / n - mean_b * mean_b
    return (2 * mean_a * mean_b + 1e-4) * (2 * shared + 9e-4) / ((mean_a * mean_a + mean_b * mean_b + 1e-4) * (spread + 9e-4))
