"""Document fingerprints against plain code."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.llm import fuzzy

M = (1 << 64) - 1


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M
    return x ^ x >> 31


def byte(b):
    return mix((b + 1) * fuzzy._BASE & M)


def plain_print(text):
    """One piece after the other, byte by byte."""
    data = text.encode()
    k = 2
    while 64 << k < len(data):
        k += 1
    depth = []
    for i in range(len(data)):
        roll = 0
        for b in data[max(0, i - 6) : i + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + byte(b)) & M
        ones = mix(roll)
        depth.append(len(bin(ones)) - len(bin(ones).rstrip("1")) if i >= 6 else -1)
    cuts = lambda k: sorted({i + 1 for i, d in enumerate(depth) if d >= k} | ({len(data)} if data else set()))
    while len(cuts(k)) > 128:
        k += 1
    out = []
    for level in (k, k + 1):
        at, signs = 0, ""
        for end in cuts(level):
            h = sum(byte(b) * pow(fuzzy._BASE, j, 1 << 64) for j, b in enumerate(data[at:end])) & M
            sign = mix((h + end - at) & M) >> 52
            signs += fuzzy.DIGITS[sign >> 6] + fuzzy.DIGITS[sign & 63]
            at = end
        out.append(signs)
    return f"{k}:{out[0]}:{out[1]}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def prose(rng, n):
    return " ".join(rng.choice("the of and énd word tion shed ing 漢字 a, or. it") + str(rng.randrange(50)) for _ in range(n))


def print_of(text):
    data = np.frombuffer(text.encode() or b"x", np.uint8)[: len(text.encode())]
    return fuzzy.fingerprints_of(data, np.array([0, len(data)]))[0]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ["", "a", "abcdefg", "abcdefgh" * 300, "ab" * 900, *[prose(rng, n) for n in (1, 2, 5, 40, 300, 900, 2500)], ""]


def test_fingerprints_match_plain_code_in_any_slices(texts, monkeypatch):
    want = [plain_print(t) for t in texts]
    data = [t.encode() for t in texts]
    for size in (1 << 18, 64, 7, 5):
        monkeypatch.setattr(fuzzy, "SLICE", size)
        got = fuzzy.fingerprints_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert got == want


def test_periodic_texts_have_bounded_signatures():
    for period in range(1, 40):
        rng = random.Random(period)
        text = "".join(rng.choice("abcdef ") for _ in range(period)) * (200_000 // period)
        k, one, two = print_of(text).split(":")
        assert len(two) <= len(one) <= 4 * fuzzy.PIECES


def test_edit_distance_matches_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(90))] for _ in range(2))
        assert fuzzy.edit_distance(a, b) == plain_distance(a, b)


def test_likeness():
    rng = random.Random(6)
    text = prose(rng, 800)
    own = print_of(text)
    assert fuzzy.likeness(own, own) == 1.0
    assert fuzzy.likeness(own, print_of(text.replace("word7 ", "other ", 2))) > 0.85
    assert fuzzy.likeness(own, print_of(text[: len(text) // 2] + prose(rng, 400))) > 0.3
    assert fuzzy.likeness(own, print_of(text + " " + prose(rng, 700))) > 0.3  # twice the block size
    assert fuzzy.likeness(own, print_of(prose(random.Random(99), 800))) < 0.15
    assert fuzzy.likeness(own, print_of("")) == 0.0
    assert fuzzy.likeness(print_of(""), print_of("")) == 1.0
    assert fuzzy.likeness(own, print_of(text * 9)) == 0.0  # no common block size


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'q' AS h", "1 AS bucket", "true AS guest", "'x' AS fingerprint", "0 AS turn", "CAST(NULL AS STRING) AS nulls")


def plain_rows(spark, rows):
    hashes = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, changed, other = map(plain_print, (t, edited, following))
        near = []
        for x in (changed, other):
            a, b = ({int(s.split(":")[0]) + j: [v[m : m + 2] for m in range(0, len(v), 2)] for j, v in enumerate(s.split(":")[1:])} for s in (own, x))
            alike = [1 - plain_distance(a[k], b[k]) / max(len(a[k]), len(b[k])) for k in a.keys() & b.keys() if a[k] and b[k]]
            near.append(1.0 if own == x else max(alike, default=0.0))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near))
    return out


def sort(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_edited_likeness_matches_plain_code(spark, texts):
    rng = random.Random(8)
    rows = [(i * 7 - 40, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), (None, "no id"), (None, None), (-(1 << 63), "least"), ((1 << 63) - 1, "most é"), (3, "twice"), (3, "other"), (3, "twice")]
    rows += [(1000 + i, prose(rng, rng.randrange(60))) for i in range(80)]
    rng.shuffle(rows)
    got = fuzzy.digest(fuzzy.edited_likeness(frame(spark, rows).repartition(3))).collect()
    assert sort(got) == sort(plain_rows(spark, rows))


def test_few_rows(spark):
    assert fuzzy.edited_likeness(frame(spark, [])).count() == 0
    assert fuzzy.fingerprints(frame(spark, [])).count() == 0
    for rows in ([(5, "alone with itself")], [(1, None)], [(1, "a"), (2, "b")]):
        assert sort(fuzzy.digest(fuzzy.edited_likeness(frame(spark, rows))).collect()) == sort(plain_rows(spark, rows))


def test_columns_of_fingerprints(spark, texts):
    got = fuzzy.fingerprints(frame(spark, list(enumerate(texts)) + [(None, None)])).withColumn("same", fuzzy.alike(F.col("fingerprint"), F.col("fingerprint")))
    assert sort(got.select("doc_id", "fingerprint", "same").collect()) == sort([(i, plain_print(t), 1.0) for i, t in list(enumerate(texts)) + [(None, "")]])


def test_a_long_text_takes_little_more_than_its_bytes():
    import tracemalloc

    data = np.frombuffer(b"some words of a long text 0123456789 " * 2_000_000, np.uint8)
    tracemalloc.start()
    fuzzy.fingerprints_of(data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
