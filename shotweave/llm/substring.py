"""Removal of long passages that an earlier document already has."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, mix, text_or_empty, whole_ids, word_hashes
from .packed import CHUNK, CODEC, PER_BUCKET, batch_of, cut_by_bucket, dealt, for_two_passes, layout, long, named_chunks, short, small, text_bytes, texts_by_chunk, wide

WINDOW = 13
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A null doc_id is later than any other.
LAST = (1 << 63) - 1


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of so many words within one text: their hashes, how many each text has, and
    how many words each text has. Windows are in order of text, then place."""
    words, n_words = word_hashes(data, offsets)
    n_windows = np.maximum(n_words - window + 1, 0)
    if not n_windows.sum():
        return np.empty(0, np.uint64), n_windows, n_words
    n = len(words) - window + 1
    total = np.zeros(n, np.uint64)
    for j in range(window):
        total *= _STEP
        total += words[j : n + j]
    begins = np.cumsum(n_words) - n_words
    local = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    return mix(total[np.repeat(begins, n_windows) + local]), n_windows, n_words


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each hash, from bits that its order among the bucket's hashes doesn't use first."""
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class _Chunk:
    """The windows of a chunk of texts: distinct hashes in order, and for each the earliest text of the chunk that has it."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int):
        hashes, self.n_windows, self.n_words = window_hashes(data, offsets, window)
        self.ids, place = np.unique(ids, return_inverse=True)  # texts of one id aren't earlier than each other
        self.rank = np.repeat(place, self.n_windows)
        self.distinct, self.inverse = np.unique(hashes, return_inverse=True)
        self.first = np.full(len(self.distinct), len(self.ids), np.int64)
        np.minimum.at(self.first, self.inverse, self.rank)


def earlier_windows(docs: DataFrame, window: int, buckets: int, chunk: int) -> DataFrame:
    """Which windows an earlier text outside of their chunk has. ``docs``: doc_id long (no nulls), key long, text string.

    Each chunk of texts sends its distinct windows once, with the earliest of its texts that has each, however many
    have it; a passage that very many documents share reaches its bucket once for each chunk. Returns for each
    chunk and bucket a bit for each of the chunk's windows there, in order of hash: chunk, bucket, data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, data, offsets in named_chunks(batches, chunk):
            c = _Chunk(ids, data, offsets, window)
            place, edges = cut_by_bucket(_buckets(c.distinct, buckets), buckets)
            for k in np.flatnonzero(np.diff(edges)):
                mine = place[edges[k] : edges[k + 1]]
                named, first = np.unique(c.first[mine], return_inverse=True)  # only ids that these windows name go along
                packed = short(c.distinct[mine], 8), small(first), small(np.diff(c.ids[named], prepend=np.int64(0)))
                yield batch_of([[k], [name], *[[x] for x in packed]], ["bucket", "chunk", "hashes", "first", "ids"], pa.int32(), pa.int64())

    def judge(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = [long(r[1]) for r in held]
        owner = np.concatenate([np.cumsum(wide(r[3]))[wide(r[2])] for r in held])
        sizes = list(map(len, hashes))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        h, d = hashes[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        late = np.empty(len(h), bool)
        late[order] = d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(h))))
        at = 0
        for r, n in zip(held, sizes):
            yield batch_of([[r[0]], [bucket], [np.packbits(late[at : at + n]).tobytes()]], ["chunk", "bucket", "data"], pa.int64(), pa.int32())
            at += n

    packed = docs.mapInArrow(pack, "bucket int, chunk long, hashes binary, first binary, ids binary")
    return dealt(packed, "bucket", ["chunk", "hashes", "first", "ids"], "chunk long, bucket int, data binary", judge)


def covered_words(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words flagged windows cover: overlapping windows merge into maximal runs. ``starts``: a flag a window."""
    change = np.zeros(n_words + 1, np.int64)
    change[: len(starts)] += starts
    change[window : window + len(starts)] -= starts
    return np.cumsum(change[:n_words]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, per_bucket: int = PER_BUCKET, chunk: int = CHUNK, rereadable: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose words, in order, also start in a document with
    a smaller doc_id. Windows are judged on the input.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space),
    spans (maximal removed runs of words as [begin, end) pairs, flat).
    Null texts have no words. A null doc_id is later than any other, and null ones aren't earlier than each other.
    Rows that repeat a doc_id aren't earlier than each other either; each is judged by its own text. Texts of fewer
    words than a window lose nothing. An empty table gives an empty one. Extra columns, of whatever name, are not read. Windows are
    compared by a 64-bit hash. A text of any length is cleaned whole; it is a chunk of its own, some 100 bytes a word in a task.
    ``docs`` is read twice and stored first, unless it is ``rereadable``: straight from files.
    """
    source = columns(whole_ids(docs), "doc_id", "text").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = source.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    rows = for_two_passes(rows, rereadable)
    buckets, chunk = layout(text_bytes(rows), per_bucket, chunk)

    def remove(name: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        answers = {r[0]: r[1] for r in held if r[0] >= 0}  # chunks of one name are equal, and so are their answers
        for _, packed, raw_ids, offsets in (r for r in held if r[0] < 0):
            ids, offsets = np.frombuffer(raw_ids, np.int64), np.frombuffer(offsets, np.int64)
            text = pa.decompress(packed, int(offsets[-1]), codec=CODEC, asbytes=True)
            c = _Chunk(ids, np.frombuffer(text, np.uint8), offsets, window)
            place, edges = cut_by_bucket(_buckets(c.distinct, buckets), buckets)
            late = np.zeros(len(c.distinct), bool)
            for k in np.flatnonzero(np.diff(edges)):
                mine = place[edges[k] : edges[k + 1]]
                late[mine] = np.unpackbits(np.frombuffer(answers[int(k)], np.uint8), count=len(mine)).astype(bool)
            flags = late[c.inverse] | (c.rank > c.first[c.inverse])
            begins, out = np.cumsum(c.n_windows) - c.n_windows, []
            for i in range(len(ids)):
                words, starts = text[offsets[i] : offsets[i + 1]].split(), flags[begins[i] : begins[i] + c.n_windows[i]]
                spans: list[int] = []
                if starts.any():
                    gone = covered_words(starts, len(words), window)
                    spans = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                    kept = b" ".join(compress(words, ~gone))
                else:
                    kept = b" ".join(words)
                out.append((len(words), sum(spans[1::2]) - sum(spans[::2]), kept.decode(), spans))
            yield batch_of([ids, *zip(*out)], ["doc_id", "n_words", "n_removed", "kept_text", "spans"], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))

    chunked = earlier_windows(rows, window, buckets, chunk).unionByName(texts_by_chunk(rows, chunk), allowMissingColumns=True)
    cleaned = dealt(chunked, "chunk", ["bucket", "data", "ids", "offsets"], "doc_id long, n_words long, n_removed long, kept_text string, spans array<bigint>", remove)
    return cleaned.withColumn("doc_id", F.when(F.col("doc_id") < LAST, F.col("doc_id")))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM s) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS at FROM f, (SELECT unnest(range(0, 13)) AS j)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) FILTER (c.at IS NULL) AS kept, count(c.at) AS n_removed
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.at = x.at GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
