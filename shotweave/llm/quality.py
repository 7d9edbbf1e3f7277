"""Document quality: random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, chunks, columns, stored, text_buffers, text_or_empty, word_hashes

#: Statistics of a text, in the order in which they enter the kernel.
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digits", "dots", "shouts", "pipes", "symbols", "brackets", "non_ascii", "line_breaks", "repeats", "distinct_words", "top_word", "lower", "empty", "top_symbol")
#: Bytes of text that a task looks at together.
CHUNK = 4 << 20
N_FEATURES, WIDTH, RIDGE, SEED = 256, 6.0, 1e-3, 7
#: Cells of raw score between which isotonic regression pools.
CELLS = 1024
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """A row of 0/1 for each byte value: which kinds of character it belongs to."""
    out = np.zeros((256, 11), np.float32)
    for b in range(256):
        c = chr(b)
        out[b] = [65 <= b <= 90, 48 <= b <= 57, c in ".,;:", c in "!?", c == "|", c in "#$%&*@^~_=+\\/", c in "<>{}[]()", b >= 128, b == 10, b < 128 and bool(_IS_SPACE[b]), 97 <= b <= 122]
    return out


_KINDS = _kinds()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of texts laid end to end, a row each; all are finite for empty texts too."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    hashes, n_words = word_hashes(data, offsets)
    counts = np.zeros((n, 256), np.int64)
    for i in range(n):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    of = counts @ _KINDS
    bytes_, words = np.maximum(size, 1), np.maximum(n_words, 1)
    text = np.repeat(np.arange(n), n_words)
    pair = np.lexsort((hashes, text)) if len(hashes) else np.empty(0, int)
    new = np.ones(len(hashes), bool)
    if len(hashes):
        h, t = hashes[pair], text[pair]
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        distinct = np.bincount(t[new], minlength=n)
        again = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, t[new], runs)
    else:
        distinct = top = again = np.zeros(n, np.int64)
    mean = (size - of[:, 9]) / words
    symbols = counts[:, [ord(c) for c in "#$%&*@^~!?|"]]
    shares = np.column_stack([
        of[:, 0] / bytes_, of[:, 1] / bytes_, of[:, 2] / bytes_, of[:, 3] / bytes_, of[:, 4] / bytes_, of[:, 5] / bytes_, of[:, 6] / bytes_,
        of[:, 7] / bytes_, of[:, 8] / bytes_, again / words, distinct / words, top / words, np.minimum(of[:, 10] / bytes_, 1), (size == 0), symbols.max(axis=1) / bytes_,
    ])
    return np.column_stack([np.log1p(size), np.log1p(n_words), np.minimum(mean, 40) / 5, np.sqrt(shares)])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, in one pass. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_buffers(batch.column(1))
            rows = np.vstack([statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK)])
            flat = pa.array(rows.ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass(frozen=True)
class Model:
    """Everything a score needs: scaling of the statistics, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def fourier(x: np.ndarray, n: int = N_FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Cosines at random frequencies, whose dot products approximate exp(-|x - y|^2 / (2 width^2)), and a constant."""
    rng = np.random.default_rng(seed)
    frequencies = rng.standard_normal((x.shape[1], n)) / width
    phases = rng.uniform(0, 2 * np.pi, n)
    return np.column_stack([np.cos(np.clip(x, -8, 8) @ frequencies + phases) * np.sqrt(2 / n), np.ones(len(x))])


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _summed(rows: DataFrame, arrays, size: int) -> np.ndarray:
    """Sum a vector of fixed size over all rows: within each partition, then over a few, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += arrays(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.mapInArrow(add, "part binary").repartition(4).mapInArrow(merge, "part binary")
    return np.sum([np.frombuffer(r.part) for r in parts.collect()], axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit(labelled: DataFrame) -> Model | None:
    """Fit on all rows of stats array<double>, y double: exact sums of moments, then of the normal equations, then of
    the calibration's cells, each one row of fixed size for a partition. None where there are no rows."""
    d, m = len(STATISTICS), N_FEATURES + 1

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = _summed(labelled, moments, 2 * d + 1)
    if not s[0]:
        return None
    mean = s[1 : d + 1] / s[0]
    spread = np.sqrt(np.maximum(s[d + 1 :] / s[0] - mean**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = fourier((_matrix(batch.column(0)) - mean) / scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ np.asarray(batch.column(1))])

    s = _summed(labelled, normal, m * m + m)
    gram, right = s[: m * m].reshape(m, m), s[m * m :]
    weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.diag([*np.ones(m - 1), 0]) / m + 1e-9 * np.eye(m), right)
    draft = Model(mean, scale, weights, np.array([-1.0, 2.0]), np.array([0.0, 1.0]))

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        cell = np.clip(((draft.raw(_matrix(batch.column(0))) + 1) / 3 * CELLS).astype(int), 0, CELLS - 1)
        return np.concatenate([np.bincount(cell, minlength=CELLS), np.bincount(cell, np.asarray(batch.column(1)), CELLS)])

    s = _summed(labelled, cells, 2 * CELLS)
    n, good = s[:CELLS], s[CELLS:]
    used = np.flatnonzero(n)
    levels = pool_adjacent(good[used] / n[used], n[used])
    return Model(mean, scale, weights, (used + 0.5) / CELLS * 3 - 1, levels)


def held_out() -> Column:
    """Whether a row is never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text for quality, as ``labels.quality`` marks it.

    Returns one row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).
    Learns only from labelled rows that aren't held out; scores use nothing but the text. Null texts count as empty;
    a null doc_id is held out; a null quality is no label; labels that repeat a doc_id with other values count as
    their mean, rounded. With no labels to learn from every score is 1. An empty table gives an empty one. Extra columns, of whatever name, are not read. Whole
    texts are measured, in slices; a task holds an Arrow batch of them.
    """
    measures = stored(measured(docs), "quality-statistics")
    marks = columns(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("y"))
    learn = stored(measures.where(~held_out()).join(marks, "doc_id").select("stats", "y"), "quality-labelled")
    model = fit(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = model.score(_matrix(batch.column(1))) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = measures.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stage form: the rows of ``docs`` that the classifier doesn't reject, all columns. Rows that share a doc_id
    go only if all their texts are rejected."""
    good = quality_scores(docs, labels, threshold).where("predicted = 1").select(F.col("doc_id").alias("good_id")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["good_id"]), "left_semi")
