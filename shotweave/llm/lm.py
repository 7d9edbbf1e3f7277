"""Stupid-backoff language-model scores: n-gram counts partitioned by hash, joined to the texts' n-grams, summed per text.

The model is of order 3. S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else BACKOFF * S(w | v);
S(w | v) = c(v w) / c(v) if c(v w) > 0, else BACKOFF * c(w) / N; a text's first word has c(w) / N, its second S(w | v).
Order 2 leaves the first rule out. Counts are of all documents but the one that is scored, so that no text vouches for itself.

A text's score is a sum over its places, and the counts that a place needs lie in several hash partitions: those of its
triple, of the triple's two pairs and of its last two words. So

1. each chunk of texts sends its distinct pairs and triples with their counts to their partitions, which send the totals back;
2. with these the chunk knows which places are found. A found triple u v w adds log c(u v w) - log c(u v), else, after
   log BACKOFF, a found pair v w adds log c(v w) - log c(v), a missing one log BACKOFF + log c(w) - log N. The chunk adds
   up the part of triples and pairs itself and sends its distinct words with their
   counts, and how often each text needs each word's logarithm (more or less), to the words' partitions;
3. these send back sums for the chunk's texts.

Chunks travel with their texts, compressed, from step 1 to step 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored, text_or_empty, whole_ids, word_hashes
from .packed import CHUNK, CODEC, WORD, batch_of, cut_by_bucket, dealt, for_two_passes, layout, long, named_chunks, short, small, text_bytes, texts_by_chunk, wide
from .substring import window_hashes

BACKOFF = 0.4
#: Count of a word that no other document has.
UNSEEN = 0.5
#: Pairs (and as many triples, apart), and words of texts, that a bucket should hold.
PAIRS_PER_BUCKET, WORDS_PER_BUCKET = 2_000_000, 16_000_000


def hash_bytes(n_places: float) -> int:
    """Bytes of a pair's hash to ship (besides its bucket): so many that about no two pairs of all share one. Beyond what
    six bytes and the bucket tell apart it is seven, with the sign bit kept free for differences."""
    return 6 if n_places * n_places < 2.0**54 else 7


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the lowest 16 bits, which aren't shipped; beyond 65,536 buckets from the lowest 32."""
    bits = np.uint64(16 if n <= 1 << 16 else 32)
    return ((hashes & ((np.uint64(1) << bits) - np.uint64(1))) * np.uint64(n) >> bits).astype(np.int64)


def _gram_totals(rows: DataFrame, order: int, buckets: int, width: int, chunk: int) -> DataFrame:
    """Step 1. For each chunk and bucket of pairs, and of triples after these, how often each of the chunk's distinct ones
    occurs in all texts, in order of hash: chunk, bucket, data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, data, offsets in named_chunks(batches, chunk):
            for n in range(2, order + 1):
                grams, counts = np.unique(window_hashes(data, offsets, n)[0], return_counts=True)
                place, edges = cut_by_bucket(_bucket(grams, buckets), buckets)
                used = np.flatnonzero(np.diff(edges))
                parts = [place[edges[k] : edges[k + 1]] for k in used]
                if len(used):
                    packed = [short(grams[p], width) for p in parts], [small(counts[p]) for p in parts]
                    yield batch_of([used + (n - 2) * buckets, [name] * len(used), *packed], ["bucket", "chunk", "hashes", "counts"], pa.int32(), pa.int64())

    def count(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([long(r[1]) for r in held])
        counts = np.concatenate([wide(r[2]) for r in held]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        del hashes
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        runs = np.diff(np.append(starts, len(h)))
        del h
        totals = np.empty(len(order), np.int64)
        totals[order] = np.repeat(np.add.reduceat(counts[order], starts, dtype=np.int64), runs)
        at = 0
        for name, _, part in held:
            n = int.from_bytes(part[1:9], "little")
            yield batch_of([[name], [bucket], [small(totals[at : at + n])]], ["chunk", "bucket", "data"], pa.int64(), pa.int32())
            at += n

    packed = rows.mapInArrow(pack, "bucket int, chunk long, hashes binary, counts binary")
    return dealt(packed, "bucket", ["chunk", "hashes", "counts"], "chunk long, bucket int, data binary", count)


_SENT = ["bucket", "chunk", "words", "totals", "per_word", "doc", "times", "own", "ids", "base", "missing", "n_words"]


_SUMMED = ["chunk", "of", "parts", "ids", "base", "missing", "n_words"]


def _needs(doc_of: np.ndarray, words: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
    """How often each text needs each of its words, by word, then text: word, text, times, own count."""
    word, inverse = np.unique(words, return_inverse=True)
    key, inverse, own = np.unique(inverse * n_docs + doc_of, return_inverse=True, return_counts=True)
    return word[key // n_docs], key % n_docs, np.bincount(inverse, times, len(key)).astype(np.int64), own


def _others(data: np.ndarray, offsets: np.ndarray, n: int, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of n words of a chunk's texts, how often other texts have it; its text; its number within the text."""
    grams, n_grams, _ = window_hashes(data, offsets, n)
    doc_of = np.repeat(np.arange(len(n_grams)), n_grams)
    if not len(grams):
        return np.empty(0, np.int64), doc_of, doc_of
    distinct, inverse = np.unique(grams, return_inverse=True)
    place, edges = cut_by_bucket(_bucket(distinct, buckets), buckets)
    totals = np.zeros(len(distinct), np.int64)
    for k in np.flatnonzero(np.diff(edges)):
        totals[place[edges[k] : edges[k + 1]]] = wide(answers[int(k) + (n - 2) * buckets])
    _, again, own = np.unique(doc_of * len(distinct) + inverse, return_inverse=True, return_counts=True)
    return totals[inverse] - own[again], doc_of, np.arange(len(grams)) - (np.cumsum(n_grams) - n_grams)[doc_of]


def _word_requests(chunked: DataFrame, order: int, gram_buckets: int, buckets: int, width: int) -> DataFrame:
    """Step 2, for each chunk and bucket of words (_SENT). ``chunked`` has both of step 1's tables."""

    def score(name: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        answers = {r[0]: r[1] for r in held if r[0] >= 0}  # chunks of one name are equal, and so are their answers
        for _, packed, ids, offsets in (r for r in held if r[0] < 0):
            offsets = np.frombuffer(offsets, np.int64)
            data = np.frombuffer(pa.decompress(packed, int(offsets[-1]), codec=CODEC, asbytes=True), np.uint8)
            n_docs = len(offsets) - 1
            words, n_words = word_hashes(data, offsets)
            doc_of_word = np.repeat(np.arange(n_docs), n_words)
            others, doc_of_pair, at_pair = _others(data, offsets, 2, answers, gram_buckets)
            found = others > 0
            part = np.where(found, np.log(np.maximum(others, 1)), math.log(BACKOFF))
            whole = np.zeros(len(others), bool)
            if order > 2:
                last = np.flatnonzero(at_pair)  # pairs that end a triple, in the triples' order; each triple's first pair is before it
                triples = _others(data, offsets, 3, answers, gram_buckets)[0]
                whole[last] = triples > 0
                part[last] = np.where(triples > 0, np.log(np.maximum(triples, 1)) - np.log(np.maximum(others[last - 1], 1)), part[last] + math.log(BACKOFF))
            missing = np.bincount(doc_of_pair, ~found & ~whole, n_docs)
            base = np.bincount(doc_of_pair, part, n_docs)
            first = np.cumsum(n_words) - n_words
            left = first[doc_of_pair] + at_pair
            times = np.zeros(len(words), np.int64)
            times[left] -= found & ~whole
            times[left + 1] += ~found & ~whole
            times[first[n_words > 0]] += 1
            texts = [ids, base.tobytes(), (missing + (n_words > 0)).astype(np.int64).tobytes(), n_words.astype(np.int64).tobytes()]
            if not len(words):
                yield batch_of([[0], [name], *[[b""]] * 6, *[[x] for x in texts]], _SENT, pa.int32(), pa.int64())
                continue
            word, doc, times, own = _needs(doc_of_word, words, times, n_docs)
            place, edges = cut_by_bucket(_bucket(word, buckets), buckets)
            for n, k in enumerate(np.flatnonzero(np.diff(edges))):
                mine = place[edges[k] : edges[k + 1]]
                starts = np.flatnonzero(np.concatenate([[True], word[mine][1:] != word[mine][:-1]]))
                used = times[mine] != 0
                u = mine[used]
                numbers = [small(x) for x in (np.add.reduceat(own[mine], starts), np.add.reduceat(used, starts, dtype=np.int64), doc[u], times[u], own[u])]
                row = [int(k), name, short(word[mine][starts], width), *numbers, *(texts if n == 0 else [b""] * 4)]
                yield batch_of([[x] for x in row], _SENT, pa.int32(), pa.int64())

    return dealt(chunked, "chunk", ["bucket", "data", "ids", "offsets"], "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in _SENT[2:]), score)


def _sums(requests: DataFrame) -> DataFrame:
    """Step 3. doc_id, part, n_missing, n_words of each text."""

    def add(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = [long(r[1]) if r[1] else np.empty(0, np.uint64) for r in held]
        totals = np.concatenate([wide(r[2]) if r[2] else np.empty(0, np.int64) for r in held])
        _, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, totals).astype(np.int64)[inverse] if len(totals) else totals
        at = 0
        for w, (name, _, _, per_word, doc, times, own, *texts) in zip(words, held):
            parts = of = np.empty(0)
            if len(w):
                mine = counts[at : at + len(w)]
                at += len(w)
                others = np.repeat(mine, wide(per_word)) - wide(own)
                of, place = np.unique(wide(doc), return_inverse=True)  # only texts that need these words go along
                parts = np.bincount(place, wide(times) * np.log(np.maximum(others, UNSEEN)), len(of))
            packed = small(np.diff(of.astype(np.int64), prepend=np.int64(0))), parts.astype(np.float64).tobytes(), *texts
            yield batch_of([[name], *[[x] for x in packed]], _SUMMED, pa.int64())

    def merge(name: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # Chunks of one name are equal; each has its own texts, and adds equal parts.
        firsts = [r for r in held if r[2]]
        ids, base, missing, n_words = (np.frombuffer(x, t) for x, t in zip(firsts[0][2:], (np.int64, np.float64, np.int64, np.int64)))
        total = np.zeros(len(ids))
        for r in held:
            total[np.cumsum(wide(r[0]))] += np.frombuffer(r[1])
        for _ in firsts:
            told = ids, base + total / len(firsts), missing, n_words
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], ["doc_id", "part", "n_missing", "n_words"])

    sums = dealt(requests, "bucket", _SENT[1:], "chunk long, " + ", ".join(f"{c} binary" for c in _SUMMED[1:]), add)
    return dealt(sums, "chunk", _SUMMED[1:], "doc_id long, part double, n_missing long, n_words long", merge)


#: Stands for a null doc_id within the passes.
_NULL = -(1 << 63)


def backoff_scores(docs: DataFrame, order: int = 3, rereadable: bool = False) -> DataFrame:
    """Score every whole text by the counts of all other texts of ``docs``, with a model of order 2 or 3.

    Returns one row per row: doc_id, n_words, log_score (natural logarithm, summed over the words), mean_log_score
    (per word). Words are separated by white space and unchanged. A text without words, or null, scores 0.
    A word that no other text has counts UNSEEN. If no other text has any words, N counts as 1. Rows that repeat are
    texts of their own, and vouch for each other. Null ids are kept. An empty table gives an empty one. Extra columns, of whatever name, are not read.
    A text of any length is scored whole; it is a chunk of its own, some 100 bytes a word in a task.
    ``docs`` is read twice and stored first, unless it is ``rereadable``: straight from files.
    """
    source = columns(whole_ids(docs), "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), text_or_empty().alias("text"))
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    rows = source.select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = for_two_passes(rows, rereadable)
    size = text_bytes(rows)
    pair_buckets, chunk = layout(size, PAIRS_PER_BUCKET, CHUNK)
    word_buckets = -(-pair_buckets * PAIRS_PER_BUCKET // WORDS_PER_BUCKET)
    width = hash_bytes(size / WORD)
    totals = _gram_totals(rows, order, pair_buckets, width, chunk)
    chunked = totals.unionByName(texts_by_chunk(rows, chunk), allowMissingColumns=True)
    scored = stored(_sums(_word_requests(chunked, order, pair_buckets, word_buckets, width)), "lm-scores")
    n_all = float(scored.agg(F.sum("n_words")).first()[0] or 0)
    log_n = F.log(F.greatest(F.lit(n_all) - F.col("n_words"), F.lit(1.0)))
    score = F.round(F.col("part") - F.col("n_missing") * log_n, 6)
    mean = F.round(F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0), 6)
    return scored.select(F.when(F.col("doc_id") > _NULL, F.col("doc_id")).alias("doc_id"), "n_words", score.alias("log_score"), mean.alias("mean_log_score"))
