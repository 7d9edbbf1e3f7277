"""Hashes of many windows packed in few rows: a task ships one row for each bucket of hash values, not one for each
window, and Spark deals the rows by bucket. Shared by substring dedup and language-model counts, whose plain form (a row
for each window, grouped by hash and joined back) moves several times as many bytes (figures in the README)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, stored, text_buffers

#: Bytes of text whose windows are hashed together, and windows that a bucket should hold.
CHUNK, PER_BUCKET = 4 << 20, 2_000_000
#: Both grow with the data, up to what a task can hold, so that a chunk has so many windows for each bucket.
PER_CELL, MOST_CHUNK, MOST_BUCKET = 512, 64 << 20, 16_000_000
#: Bytes of text for one window, about.
WORD = 5


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of ``docs`` (text string): a sum over all rows, one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def layout(size: int, per_bucket: int = PER_BUCKET, chunk: int = CHUNK) -> tuple[int, int]:
    """(buckets, bytes of a chunk) for ``size`` bytes of text.

    A chunk sends a row to each bucket, so rows are chunks times buckets. Where that would leave few windows to a row, chunks
    and buckets grow alike with the root of the size, and rows in proportion to it. Beyond about 1 TB both are as large as a
    task can hold and a row has fewer windows, some six at 100 TB, where its frame of about 80 bytes costs more than they do."""
    short = PER_CELL * (size / WORD) / (per_bucket * max(1.0, chunk / WORD))
    if short > 1:
        per_bucket, chunk = (max(x, min(most, int(x * short**0.5))) for x, most in ((per_bucket, MOST_BUCKET), (chunk, MOST_CHUNK)))
    return max(1, -(-size // (WORD * per_bucket))), chunk


def for_two_passes(rows: DataFrame, rereadable: bool) -> DataFrame:
    """``rows`` in a form that two passes read in the same order, whichever executors are lost: files do; what was
    shuffled on the way needn't, and is stored."""
    return rows if rereadable else stored(rows, "texts")


def dealt(packed: DataFrame, key: str, columns: list[str], schema: str, work: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Deal packed rows by ``key`` and call ``work(key, rows)`` with all rows of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if row[0] != current and held:
                    yield from work(current, held)
                    held = []
                current = row[0]
                held.append(row[1:])
        if held:
            yield from work(current, held)

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.select(key, *columns).repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)


def chunk_key(ids: np.ndarray, keys: np.ndarray) -> int:
    """A name for a chunk of texts that a repeated task gives it again."""
    places = np.arange(1, len(ids) + 1, dtype=np.uint64)
    return int(mix(mix(ids.view(np.uint64) ^ mix(keys.astype(np.int64).view(np.uint64))) + places).sum(dtype=np.uint64).view(np.int64))


def cut_by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal buckets together and keeps it otherwise, and where each bucket begins (n + 1 edges)."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


CODEC, LEVEL = "zstd", 5


def small(numbers: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: the high bytes, mostly equal, take next to no room."""
    n = numbers.astype(np.int64)
    plain = ((n << 1) ^ (n >> 63)).view(np.uint64)  # the sign goes to the lowest bit
    width = max(1, -(-int(plain.max()).bit_length() // 8)) if len(plain) else 1
    planes = np.ascontiguousarray(plain.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(n).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec=CODEC, asbytes=True)


def wide(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec=CODEC, asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    plain = out.view(np.uint64).ravel()
    return (plain >> np.uint64(1)).view(np.int64) ^ -(plain & np.uint64(1)).view(np.int64)


def short(hashes: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of ascending hashes, as differences."""
    return small(np.diff((hashes >> np.uint64(64 - 8 * width)).view(np.int64), prepend=np.int64(0)))


def long(data: bytes) -> np.ndarray:
    return np.cumsum(wide(data)).view(np.uint64)


def batch_of(fields: list, names: list[str], *kinds: pa.DataType) -> pa.RecordBatch:
    kinds += (pa.binary(),) * (len(names) - len(kinds))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, kinds)], names)


def named_chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, ids, bytes, offsets) of each chunk of texts; the same from every pass over the same rows. Texts are carried over from
    batch to batch until a chunk is full, so short texts don't make small chunks."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # ids, keys, bytes, sizes of texts
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            data, offsets = text_buffers(batch.column(2))
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), data[offsets[0] : offsets[-1]], np.diff(offsets)))
            size += len(held[-1][2])
            if size < most_bytes:
                continue
        if not held:
            continue
        ids, keys, data, sizes = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
        offsets = np.append(0, np.cumsum(sizes))
        runs = chunks(offsets, most_bytes)
        last = [] if batch is None else runs[-1:]  # it may go on in the next batch
        for a, b in runs[: len(runs) - len(last)]:
            yield chunk_key(ids[a:b], keys[a:b]), ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        held = [(ids[a:b], keys[a:b], data[offsets[a] : offsets[b]].copy(), sizes[a:b]) for a, b in last]
        size = sum(len(x[2]) for x in held)


def texts_by_chunk(rows: DataFrame, most_bytes: int) -> DataFrame:
    """The texts (doc_id, key, text) of each chunk, compressed: chunk, bucket (-1), data, ids, offsets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC, compression_level=LEVEL)
        for name, ids, data, offsets in named_chunks(batches, most_bytes):
            texts = [[codec.compress(data.tobytes(), asbytes=True)], [ids.tobytes()], [offsets.astype(np.int64).tobytes()]]
            yield batch_of([[name], [-1], *texts], ["chunk", "bucket", "data", "ids", "offsets"], pa.int64(), pa.int32())

    return rows.mapInArrow(pack, "chunk long, bucket int, data binary, ids binary, offsets binary")
