"""Fingerprints of documents that tell how alike two texts are: context-triggered piecewise hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, mix, text_buffers, text_or_empty, whole_ids

#: Bytes that decide on a boundary, bytes hashed at a time, and bytes of texts that are worked on together.
WINDOW, SLICE, TOGETHER = 7, 1 << 18, 1 << 20
#: A block size of 2 ** k gives up to so many pieces; it is doubled where a text has more than twice as many.
PIECES, LEAST_K = 64, 2
# Digits of a signature, two for each piece.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = np.array([[ord(a), ord(b)] for a in DIGITS for b in DIGITS], np.uint8)
_ROLL, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(SLICE, np.uint64(x))), dtype=np.uint64) for x in (_BASE, _INVERSE))
_WHOLE = (1 << 64) - 1


def _cuts(data: np.ndarray, ends: np.ndarray, loosest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where a piece may end, in texts laid end to end that end at ``ends``: place, how often the block size can be
    doubled with a boundary still there (a text's end: always), the hash of all bytes before the place, and the inverse power of the base for it.

    A boundary is where the rolling hash of the last WINDOW bytes of a text, mixed, ends in k ones; ``loosest`` has each
    text's least k. Bytes are hashed slice by slice, with state carried over, so no array is longer than a slice."""
    found: list[tuple] = []
    before, first = 0, 0  # hash of the slices before, and the text that the slice begins in
    starts = np.append(0, ends[:-1])
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        shown = _BYTES[data[max(0, at - WINDOW + 1) : at + len(part)]]
        left = len(shown) - len(part)
        rolling = np.zeros(len(part), np.uint64)
        for back in range(WINDOW - 1, -1, -1):
            rolling *= _ROLL
            skip = max(0, back - left)
            rolling[skip:] += shown[left + skip - back : max(0, len(shown) - back)]
        ones = ~mix(rolling)
        last = int(np.searchsorted(ends, at + len(part) - 1, "right"))
        span = np.diff(np.clip(np.append(starts[first : last + 1], ends[last]), at, at + len(part)))
        mask = np.repeat((np.uint64(1) << loosest[first : last + 1].astype(np.uint64)) - np.uint64(1), span)
        place = np.flatnonzero((ones & mask) == 0)
        text = np.searchsorted(ends, at + place, "right")
        place = place[at + place - starts[text] >= WINDOW - 1]
        low = ones[place]
        stop = ends[first : last + 1] - at
        stop = stop[(stop > 0) & (stop <= len(part))]
        every = np.union1d(place + 1, stop)
        depth = np.zeros(len(every), np.int64)
        lowest = low & (~low + np.uint64(1))
        depth[np.searchsorted(every, place + 1)] = np.where(low == 0, 64, np.log2(np.maximum(lowest, 1).astype(np.float64))).astype(np.int64)
        depth[np.searchsorted(every, stop)] = 64
        sums = np.cumsum(shown[left:] * _UP[: len(part)], dtype=np.uint64)
        scale = np.uint64(pow(_BASE, at, 1 << 64))
        found.append((at + every, depth, np.uint64(before) + scale * sums[every - 1], np.uint64(pow(_INVERSE, at, 1 << 64)) * _DOWN[every]))
        before = (before + int(scale) * int(sums[-1])) & _WHOLE
        first = int(np.searchsorted(ends, at + len(part), "right"))
    if not found:
        return (*[np.empty(0, np.int64)] * 2, *[np.empty(0, np.uint64)] * 2)
    return tuple(np.concatenate(x) for x in zip(*found))


def _signatures(text: np.ndarray, place: np.ndarray, total: np.ndarray, inverse: np.ndarray, n_texts: int) -> list[str]:
    """For each text, two digits for the hash of each piece. Pieces end at ``place``; ``text`` has each one's text."""
    begin, before, back = (np.append(x0, x[:-1]) for x0, x in ((np.int64(0), place), (np.uint64(0), total), (np.uint64(1), inverse)))
    hashes = mix((total - before) * back + (place - begin).astype(np.uint64))
    shown = _PAIRS[(hashes >> np.uint64(52)).astype(np.int64)].tobytes().decode()
    edges = (2 * np.searchsorted(text, np.arange(n_texts + 1))).tolist()
    return [shown[a:b] for a, b in zip(edges, edges[1:])]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprints of texts laid end to end: ``k:pieces at block size 2**k:pieces at 2**(k + 1)``."""
    n = len(offsets) - 1
    ends = np.asarray(offsets[1:] - offsets[0], np.int64)
    sizes = np.diff(offsets)
    k = np.maximum(LEAST_K, np.ceil(np.log2(np.maximum(sizes, 1) / PIECES))).astype(np.int64)
    some = sizes > 0  # an empty text ends where the one before ends
    named = np.flatnonzero(some)
    place, depth, total, inverse = _cuts(data[offsets[0] : offsets[-1]], ends[some], k[some])
    text = named[np.searchsorted(ends[some], place - 1, "right")] if len(place) else place
    while True:  # texts with too many boundaries, such as periodic ones, take larger blocks
        more = np.bincount(text[depth >= k[text]], minlength=n) > 2 * PIECES
        if not more.any():
            break
        k[more] += 1
    levels = []
    for up in (0, 1):
        on = depth >= np.minimum(k + up, 64)[text]
        levels.append(_signatures(text[on], place[on], total[on], inverse[on], n))
    return [f"{a}:{b}:{c}" for a, b, c in zip(k.tolist(), *levels)]


def edit_distance(one: list[str], other: list[str]) -> int:
    """Insertions, deletions and replacements between two lists, a column of the table at a time as bits of integers."""
    if not one or not other:
        return max(len(one), len(other))
    at: dict[str, int] = {}
    for i, x in enumerate(one):
        at[x] = at.get(x, 0) | 1 << i
    if not any(x in at for x in other):
        return max(len(one), len(other))
    full = (1 << len(one)) - 1
    top, score, plus, minus = 1 << len(one) - 1, len(one), full, 0
    for x in other:
        same = at.get(x, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
    return score


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, from 0 to 1: of the block sizes that both have, the best of one minus the edit distance over
    the longer signature. Without a common block size 0; equal fingerprints 1."""
    if one == other:
        return 1.0
    sides = []
    for shown in (one, other):
        k, *levels = shown.split(":")
        sides.append({int(k) + i: [s[j : j + 2] for j in range(0, len(s), 2)] for i, s in enumerate(levels)})
    best = 0.0
    for k in sides[0].keys() & sides[1].keys():
        a, b = sides[0][k], sides[1][k]
        best = max(best, 1 - edit_distance(a, b) / max(len(a), len(b), 1) if a and b else 0.0)
    return best


def _texts_prints(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    for a, b in chunks(offsets, TOGETHER):
        yield a, b, fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text, one row per row of ``docs``; equal texts have equal fingerprints.

    A null text counts as empty, and an empty one's fingerprint has no pieces. doc_id may be of any type, null too. Texts are hashed in slices, so
    a long one takes no more memory than its bytes. An empty table gives an empty one. Extra columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, prints in _texts_prints(*text_buffers(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(prints)], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def alike(one: Column, other: Column) -> Column:
    """:func:`likeness` of two columns of fingerprints; null where either is."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([None if x is None or y is None else likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(one, other)


# --- each document beside the next one --------------------------------------------------------------
_ORDER = ["nulls", "turn", "h"]


def _sort_keys(nulls: np.ndarray, turn: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys whose order as bytes is that of (nulls, turn, h)."""
    out = np.empty((len(turn), 17), np.uint8)
    out[:, 0] = nulls
    for at, x in ((1, turn), (9, h)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def beside_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending order of doc_id; after the last comes the first. Returns bucket,
    guest, doc_id, text: rows in the order within a partition, and after the last of a bucket, as a guest, the one that comes next.

    Only ids and hashes are ordered first, which gives the first row of each range; then each text is shuffled once, to its
    range, and the first of a range also to the range before. Null ids come last; rows of one id (or null) in the order of a hash of the
    text, so that even a hot id is dealt over many ranges; equal rows are alike."""
    rows = columns(whole_ids(docs), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    turn = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))  # descending, and safe for the least long
    rows = rows.select(F.col("doc_id").isNull().alias("nulls"), turn.alias("turn"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*_ORDER).repartitionByRange(n, *_ORDER)
    heads = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_ORDER)).alias("head")).select("head.*").collect()  # a row for each range
    firsts = np.sort(_sort_keys(*[np.array([r[i] for r in heads]) for i in range(3)])) if heads else np.empty(0, "S17")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = _sort_keys(*[np.asarray(batch.column(i).cast(pa.int64())) for i in range(3)])
            bucket = np.searchsorted(firsts, mine, "right") - 1
            head = np.flatnonzero(firsts[bucket] == mine)
            head = head[np.unique(bucket[head], return_index=True)[1]]  # of equal rows one is enough
            every = np.concatenate([np.arange(batch.num_rows), head])
            guest = np.arange(len(every)) >= batch.num_rows
            to = np.where(guest, (bucket[every] - 1) % len(firsts), bucket[every])
            taken = batch if not len(head) else pa.RecordBatch.from_arrays([c.take(pa.array(every)) for c in batch.columns], batch.schema.names)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest), *taken.columns], ["bucket", "guest", *taken.schema.names])

    dealt = rows.mapInArrow(deal, "bucket int, guest boolean, nulls boolean, turn long, h long, doc_id long, text string")
    ordered = dealt.repartitionById(max(1, len(firsts)), "bucket").sortWithinPartitions("bucket", "guest", *_ORDER)
    return ordered.select("bucket", "guest", "doc_id", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, a text edited from it, and the next document, and compare. The edited text has the last half
    of the code points (rounded down) replaced by the first as many, or all, of the next document's.

    Returns one row per row of ``docs``: doc_id, n_chars (code points), edited_text, fingerprint, edited_fingerprint, near_edited and near_next
    (:func:`likeness` of the fingerprint to the edited text's and to the next document's). The order is that of :func:`beside_next`.

    A null text counts as empty. A single document is next to itself. doc_id must be of an integer type; null ids and rows
    that repeat an id are in order by a hash of the text. Whole texts are read, one Arrow batch at a time. An empty table gives an empty one. Extra columns are not read.
    """

    def told(held: list[tuple], prints: list[str], after: tuple[str, str] | None) -> Iterator[pa.RecordBatch]:
        """Rows of ``held`` (doc_id, text, own) whose next one is in it too, or is ``after``."""
        edited: list[bytes] = []
        for (doc_id, text), (_, following) in zip(held, held[1:]):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + following[:half]).encode())
        offsets = np.cumsum([0, *map(len, edited)])
        data = np.frombuffer(b"".join(edited), np.uint8)
        for a, b, changed in _texts_prints(data, offsets):
            near = [likeness(x, y) for x, y in zip(prints[a:b], changed)], [likeness(x, y) for x, y in zip(prints[a:b], prints[a + 1 : b + 1])]
            ids, n = [r[0] for r in held[a:b]], [len(r[1]) for r in held[a:b]]
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(edited[a:b], pa.binary()).cast(pa.string()), pa.array(prints[a:b]), pa.array(changed), *[pa.array(x, pa.float64()) for x in near]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, tuple, str] | None = None  # bucket, row and fingerprint of a row whose next one has not come
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, guest = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
            data, offsets = text_buffers(batch.column(3))
            for a, b, prints in _texts_prints(data, offsets):
                rows = list(zip(batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist()))
                at = 0
                while at < len(rows):  # one bucket at a time, up to its first guest
                    stop = at + int(np.searchsorted(bucket[a + at : b], bucket[a + at], "right"))
                    guests = np.flatnonzero(guest[a + at : a + stop])
                    end = at + int(guests[0]) + 1 if len(guests) else stop
                    mine, own = rows[at:end], prints[at:end]
                    if last and last[0] == bucket[a + at]:
                        mine, own = [last[1], *mine], [last[2], *own]
                    yield from told(mine, own, None)
                    last = None if len(guests) else (int(bucket[a + at]), mine[-1], own[-1])
                    at = stop

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digest(compared: DataFrame) -> DataFrame:
    return compared.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
