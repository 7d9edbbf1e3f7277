"""Fill-in-the-middle against plain string code."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.llm import fim

WIDE = "ñandú – 日本語 🙂\n" * 700
CASES = [(1, "a\nb\nc"), (2, "a\nb\n"), (3, "\n\n\n"), (4, None), (5, ""), (6, "no break"), (7, "has <S> in it\nsecond"), (8, WIDE), (8, WIDE), (None, "x\ny\nz"), (9, "<P\n>\n<M"), (-1, "<\nS>\n<")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'q' AS output", "1 AS n", "'x' AS form", "CAST(NULL AS STRING) AS lang")


def plain(doc_id, text, seed=7, rate=100, suffix_first=50, units=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    u = re.findall(units, text, re.S)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < suffix_first:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def key(row):
    return str(row[0]), str(row[-1])


@pytest.mark.parametrize("unit, units", [("line", r"[^\n]*\n|[^\n]+"), ("char", ".")])
def test_matches_plain_code_and_restores(spark, unit, units):
    rng = random.Random(5)
    rows = CASES + [(100 + i, "".join(rng.choice("ab é\n\n漢<S>PM") for _ in range(rng.randrange(3000)))) for i in range(60)]
    cut = fim.fill_in_middle(frame(spark, rows), unit=unit)
    got = cut.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain(i, t, units=units)) for i, t in rows), key=key)
    assert sorted((tuple(r)[:-1] for r in got), key=key) == want
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seeds(spark):
    rows = [(i, f"one {i}\ntwo\nthree\nfour\n") for i in range(400)]
    got = {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(frame(spark, rows), seed=11, rate=30, suffix_first=0).collect()}
    assert got == {i: plain(i, t, 11, 30, 0) for i, t in rows}
    forms = [x[1] for x in got.values()]
    assert "spm" not in forms and 80 < forms.count("psm") < 160


@pytest.mark.parametrize("unit", fim.UNITS)
def test_tree_finds_every_place(unit, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 8)
    monkeypatch.setattr(fim, "AT_ONCE", 32)
    rng = random.Random(3)
    for n in (1, 7, 8, 9, 31, 32, 33, 65, 200):
        text = "".join(rng.choice("ab\né漢🙂") for _ in range(n))
        units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else "(?s).", text)
        tree = fim.BlockTree(np.frombuffer(text.encode(), np.uint8), unit)
        assert (tree.units, tree.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert tree.after(k) == (len(before.encode()), len(before))


def test_long_text_and_empty_table(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
    text = np.frombuffer(("line of a long text é\n" * 900_000).encode(), np.uint8)
    n, form, prefix, middle, out = fim.rearranged(text, fim.draws(7, 3), "line", 100, 50, tuple(m.encode() for m in fim.MARKS))
    a, b = sorted(h % (n + 1) for h in fim.draws(7, 3)[:2])
    assert (n, prefix, middle, len(out)) == (900_000, a * 22, (b - a) * 22, len(text) + 9)


def test_unsafe_marks_are_refused(spark):
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "x<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark, CASES), marks=marks)
