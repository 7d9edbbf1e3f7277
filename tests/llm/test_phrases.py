"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shotweave.llm import phrases
from shotweave.llm.packed import wide


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'q' AS phrase", "1 AS shard", "1 AS n", "CAST(NULL AS STRING) AS words", "2 AS rank")


def counted(rows, most_words):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, sizes


def plain(rows, most_words, least, covered=100, top=2000):
    counts, sizes = counted(rows, most_words)
    every, best = set(), set()
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in kept.items():
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ends = [max((kept[q] for q in kept if len(q) == len(p) + 1 and q[at : at + len(p)] == p), default=0) for at in (1, 0)]
            every.add((lang, " ".join(p), len(p), a, f[p[:k]], f[p[k:]], sizes[lang], score, *ends))
            if not any(len(q) > len(p) and inside(p, q) and 100 * b >= covered * a for q, b in kept.items()):
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            best.add((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return every, best


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["the", "The", "of", "é", "漢字", "new", "york", "city", "a b", "x<y", " ", "É"]
    out = [(i, " ".join(rng.choices(words, range(12, 0, -1), k=rng.randrange(60))) + rng.choice(["", ".", "\n\n", ",;: "]) + "new york city hall " * rng.randrange(3), rng.choice(["en", "en", "de", None])) for i in range(160)]
    out += [(1, None, "en"), (2, "", None), (3, " \t.,\n", "fr"), (None, "one two\tthree", "it"), (5, "New YORK\x0bcity\x0cnew\ryork", "en"), (6, "the the the the the", "de")]
    return out + out[:9]  # repeated rows


@pytest.mark.parametrize("most_words, least, shard", [(5, 3, 50), (5, 12, 700), (4, 5, 3_000_000), (3, 2, 100), (2, 4, 90), (1, 1, 80)])
def test_matches_plain_counting(spark, rows, most_words, least, shard):
    every, best = plain(rows, most_words, least)
    docs = frame(spark, rows).repartition(3)
    assert {tuple(r) for r in phrases.frequent_phrases(docs, most_words, least, shard).collect()} == every
    if most_words > 1:
        got = phrases.digest(phrases.collocations(docs, most_words, least, shard=shard)).collect()
        assert len(got) == len(best) and {tuple(r) for r in got} == best


def test_top_and_partly_covered_phrases(spark, rows):
    docs = frame(spark, rows)
    for covered, top in ((60, 2000), (100, 7), (101, 5)):
        got = {tuple(r) for r in phrases.digest(phrases.collocations(docs, 5, 4, covered, top)).collect()}
        assert got == plain(rows, 5, 4, covered, top)[1]


def test_empty_tables(spark):
    for rows in ([], [(1, None, None), (2, " . ", "en")]):
        assert phrases.collocations(frame(spark, rows)).count() == 0


def test_intervals_extend_both_ways():
    rng = random.Random(1)
    for depth in (1, 2, 4):
        text = [x for _ in range(40) for x in [*rng.choices(range(1, 7), k=rng.randrange(1, 12)), 0]]
        forward = np.array(text, np.int32)
        backward = np.append(forward[-2::-1], 0).astype(np.int32)
        count = lambda p: sum(text[i : i + len(p)] == list(p) for i in range(len(text)))
        for ahead, bwt in ((True, phrases.transform(forward, depth)), (False, phrases.transform(backward, depth))):
            low = np.append(0, np.cumsum(np.bincount(bwt)))[1:7]
            known, spelled = phrases.Intervals(np.arange(6), low, low, np.array([count((w,)) for w in range(1, 7)])), [(w,) for w in range(1, 7)]
            for _ in range(depth):
                phrase, new_low, back, n = phrases.extended(bwt, known)
                at = phrases.within(new_low, n, low, np.bincount(bwt)[1:7])  # the new word, or the end of a piece
                new = [((int(a) + 1, *spelled[p]) if ahead else (*spelled[p], int(a) + 1)) if a >= 0 else None for a, p in zip(at, phrase)]
                assert [count(p) for p in new if p] == [int(x) for p, x in zip(new, n) if p]
                assert {p for p in new if p} == {p for i in range(len(text)) if 0 not in (p := tuple(text[i : i + len(spelled[0]) + 1])) and len(p) == len(spelled[0]) + 1}
                on = np.array([p is not None for p in new])
                spelled = [p for p in new if p]
                known = phrases.Intervals(phrase[on], new_low[on], back[on], n[on])


def test_shards_hold_every_word(spark, rows):
    made = phrases.shards(frame(spark, rows), 4, 60, 90).collect()
    counts, sizes = counted(rows, 1)
    got = defaultdict(Counter)
    for r in made:
        assert r.size == sum(r.counts) and len(wide(r.forward)) == len(wide(r.backward)) >= r.size
        got[r.lang].update(dict(zip(((w,) for w in r.words), r.counts)))
    assert len({r.shard for r in made}) == len(made) > 20
    assert dict(got) == {k: v for k, v in counts.items() if v}


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 10)
    text = "One two, three four five six seven. EIGHT\n\n nine" + " ten" * 20 + "; end"
    numbers = phrases._Words()
    parts = [phrases.numbered(t, numbers) for t in phrases.tokens_of(text.encode())]
    assert len(parts) > 3
    spelled = {v: k.decode() for k, v in numbers.items()}
    pieces = " ".join("/" if x == 0 else spelled[x] for x in np.concatenate(parts).tolist())
    assert pieces == "one two / three four five six seven / eight / nine" + " ten" * 20 + " / end /"
