"""Token counts, licences, language-model scores and chat formatting."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from shotweave.llm import chat, licenses, lm, packed, tokens

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "they're  gone\n\n\nwe'll 'tis", "a<|endoftext|>b <|endoftext|>", "naïve 漢字 🙂🙂 ½ 12,345.6\t\t x", "x" * 300, "word " * 3000]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS part", "7 AS flags", "'en' AS key")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    encoder = tokenizers.Tokenizer.from_file(path)
    return path, lambda t: len(encoder.encode(t, add_special_tokens=False).ids)


def test_token_counts_match_the_library(spark, library):
    path, count = library
    rows = list(enumerate(TEXTS)) + [(90, None), (None, "null id"), (1, " ")]
    got = [tuple(r) for r in tokens.token_counts(frame(spark, rows), path).collect()]
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.token_counts(frame(spark, []), path).count() == 0


def test_every_prefix_has_its_count(library):
    path, count = library
    counter = tokens.load(path)
    for text in TEXTS[:-1]:
        table = tokens.PrefixTable(counter, text)
        assert [table.at(i) for i in range(len(text) + 1)] == [count(text[:i]) for i in range(len(text) + 1)]
        for budget in (0, 1, 3, 8):
            assert table.longest_within(budget) == max(i for i in range(len(text) + 1) if count(text[:i]) <= budget)


@pytest.mark.parametrize("text", ["ab1 !? 'll  \n x", "  a\t\tb 's", "'re'r''", "xyzzyabc" * 4, "   " * 9 + "word", "漢字カナ" * 8 + "12", "a<|endoftext|>  b"])
def test_prefixes_of_even_pieces(library, text):
    path, count = library
    table = tokens.PrefixTable(tokens.load(path), text)
    assert [table.at(i) for i in range(len(text) + 1)] == [count(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["qzxv" * 25_000, " " * 100_000 + "x", "漢" * 50_000])
def test_long_pieces_are_truncated_in_linear_time(library, text):
    path, count = library
    table = tokens.PrefixTable(tokens.load(path), text)
    n = table.longest_within(500)
    assert count(text[:n]) <= 500 < count(text[: n + 1]) or n == len(text)


def test_truncation_points(spark, library):
    path, count = library
    got = {(r.doc_id, r.budget): (r.n_chars, r.n_tokens) for r in tokens.truncation_points(frame(spark, [(1, TEXTS[2]), (2, None)]), path, [2, 1000]).collect()}
    assert got[1, 1000] == (len(TEXTS[2]), count(TEXTS[2])) and got[2, 2] == (0, 0)
    assert count(TEXTS[2][: got[1, 2][0]]) <= 2


def test_licences_and_sizes(spark):
    mit = next(t for name, t in licenses.TEXTS if name == "MIT")
    rows = [
        (1, "Some text here. Released under the MIT License. More text."), (2, "nothing to see"), (3, None), (4, ""), (5, "x y\n" + mit.upper().replace(" ", "\n") + "\nend"), (6, "licensed under CC BY-NC 4.0"), (7, "the License is under version"), (None, "Released under the MIT License."),
        (8, "// SPDX-License-Identifier: GPL-3.0-or-later"), (9, "MIT"),
    ]
    got = {(r.doc_id, r.license): r for r in licenses.license_notices(frame(spark, rows)).collect()}
    assert set(got) == {(1, "MIT"), (5, "MIT"), (6, "CC-BY-NC-4.0"), (None, "MIT"), (8, "GPL-3.0")}
    assert (got[1, "MIT"].begin_word, got[1, "MIT"].end_word, got[1, "MIT"].dice) == (3, 8, 1.0)
    assert licenses.license_notices(frame(spark, [])).count() == 0


def test_every_template_is_told_from_its_like():
    scanner = licenses.Scanner(licenses.notices())
    same = {}
    for name, text in licenses.notices():
        same.setdefault(frozenset(zip(licenses.words(text), licenses.words(text)[1:])), name)
    for name, text in licenses.notices():
        first = same[frozenset(zip(licenses.words(text), licenses.words(text)[1:]))]
        found = scanner.scan(f"Before it. {text} After it.")
        assert [(f[0], f[1]) for f in found] == [(first, 1.0)], text


def scanned(w, templates, threshold):
    """All windows of the stated widths by sets; those that explain most (shared bigrams times Dice) first, none that overlaps one before it."""
    found = set()
    for name, text in templates:
        t = licenses.words(text)
        size, want = len(t) - 1, set(zip(t, t[1:]))
        for width in {round(0.8 * size), size, round(1.25 * size)} if want else ():
            width = max(1, min(width, len(w) - 1))
            for i in range(len(w) - width):
                have = set(zip(w[i : i + width], w[i + 1 : i + width + 1]))
                d = licenses.dice(have, want)
                if d >= threshold - 1e-12:
                    found.add((-round(round(d, 6) * len(have & want), 6), -round(d, 6), i, -(i + width + 1), name))
    taken = []
    for _, d, i, j, name in sorted(found):
        if all(i >= t[3] or -j <= t[2] for t in taken):
            taken.append((name, -d, i, -j))
    return sorted(taken, key=lambda x: x[2])


def test_licence_stretches_match_brute_force():
    rng = random.Random(4)
    templates = (("A", "one two three four five six seven"), ("B", "one two three nine"), ("C", "solo"), ("D", "one two one two one three"), ("E", "two three four nine six"))
    some = 0
    for threshold in (0.8, 0.5):
        scanner = licenses.Scanner(templates, threshold)
        for _ in range(400):
            w = [rng.choice("one two three four five six seven nine zero".split()) for _ in range(rng.randint(0, 25))]
            at = rng.randint(0, len(w))
            w[at:at] = licenses.words(rng.choice(templates)[1])[rng.randint(0, 2) :]
            found = scanner.scan(" ".join(w))
            assert found == scanned(w, templates, threshold) if len(w) > 1 else not found
            some += len(found)
    assert some > 300


def test_repetitive_texts_take_linear_time():
    import time

    scanner = licenses.Scanner(licenses.notices())
    for text in ("released under the mit license " * 20_000, " ".join(t for _, t in licenses.TEXTS) * 12):
        began = time.time()
        assert len(scanner.scan(text)) > 100
        assert time.time() - began < 20


def test_backoff_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(70, None), (71, "alone"), (None, "w1 w2 w1"), (72, "w1 w2"), (72, "w1 w2")]
    own = [(i, (t or "").split()) for i, t in rows]
    c1, c2 = Counter(), Counter()
    for _, w in own:
        c1.update(w)
        c2.update(zip(w, w[1:]))
    total = sum(c1.values())

    def score(w):
        o1, o2, out = Counter(w), Counter(zip(w, w[1:])), 0.0
        for i, x in enumerate(w):
            if i and (n := c2[w[i - 1], x] - o2[w[i - 1], x]):
                out += math.log(n / (c1[w[i - 1]] - o1[w[i - 1]]))
            else:
                out += math.log((0.4 if i else 1) * max(c1[x] - o1[x], 0.5) / max(total - len(w), 1))
        return out

    want = sorted((str(i), len(w), round(score(w), 4)) for i, w in own)
    monkeypatch.setattr(packed, "PER_CELL", 0)
    for size in (4_000_000, 150):
        monkeypatch.setattr(lm, "PAIRS_PER_BUCKET", size)
        monkeypatch.setattr(lm, "CHUNK", size)
        monkeypatch.setattr(lm, "WORDS_PER_BUCKET", size)
        got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 4)) for r in lm.backoff_scores(frame(spark, rows), order=2).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)
    assert lm.backoff_scores(frame(spark, [])).count() == 0


def test_order_three_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    phrase = "p q r s t p q r".split()
    some = lambda: phrase[: rng.randint(1, 8)] if rng.random() < 0.3 else [f"w{int(rng.paretovariate(0.9))}"]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 25)) for w in some())) for i in range(60)]
    rows += [(70, None), (71, "alone"), (72, "p q"), (72, "p q"), (None, "p q r"), (73, "s p q r q p r")]
    own = [(i, (t or "").split()) for i, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    c = sum((grams(w) for _, w in own), Counter())
    total = sum(len(w) for _, w in own)

    def score(w):
        o, out = c - grams(w), 0.0
        for i, x in enumerate(w):
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    out += math.log(max(o[g], 0.5) / max(total - len(w), 1))
                elif o[g]:
                    out += math.log(o[g] / o[g[:-1]])
                    break
                else:
                    out += math.log(0.4)
        return out

    want = sorted((str(i), len(w), round(score(w), 4)) for i, w in own)
    monkeypatch.setattr(packed, "PER_CELL", 0)
    for size in (4_000_000, 150):
        monkeypatch.setattr(lm, "PAIRS_PER_BUCKET", size)
        monkeypatch.setattr(lm, "CHUNK", size)
        monkeypatch.setattr(lm, "WORDS_PER_BUCKET", size)
        got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 4)) for r in lm.backoff_scores(frame(spark, rows), order=3).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


# --- chat ------------------------------------------------------------------------------------------
def render(template, **names):
    return "".join(t for t, _ in chat.compile_template(template)(**names))


def test_templates():
    assert render("{% for x in xs %}{{ loop.index }}:{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"]) == "1:A, 2:B"
    assert render("{% set a = 1 + 2 %}{{ a }}{% if a == 3 and 'x' in 'xy' %}y{% elif false %}n{% else %}m{% endif %}") == "3y"
    assert render("{{ 'it\\'s' + \"\\n\" }}{{ m.a.b }}", m={"a": {"b": 4}}) == "it's\n4"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}"))
    assert folded == (chat.Emit(chat.Const("abcd")),)


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f() }}", "{{ x[0] }}", "{% for x in y %}", "{{ x | open }}", "{% nothing %}", "{{ 1 + }}", "{% endfor %}", "{{ _x }}"])
def test_templates_reject(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)(x=1, y=[1])


def test_undefined_names():
    with pytest.raises(chat.TemplateError):
        render("{{ nobody }}")


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>", "a\\<|b<\\|c", "<<||", "\\\\<|\n"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    segments = chat.compile_template(chat.CHATML)(m={"role": "assistant", "text": text})
    assert chat.read_turn("".join(t for t, _ in segments)) == ("assistant", text)
    assert chat.unescape("".join(t for t, masked in segments if masked)) == text
    for role in ("a\nb", text, "\n", "\\\n" + text):
        turn = "".join(t for t, _ in chat.compile_template(chat.CHATML)(m={"role": role, "text": text}))
        assert chat.read_turn(turn) == (role, text)


def test_conversation_template_joins_turns():
    turns = [{"role": "user", "text": "hi <|x|>"}, {"role": "assistant", "text": "yo\\"}]
    whole = chat.compile_template(chat.CONVERSATION)(messages=turns)
    parts = [s for t in turns for s in chat.compile_template(chat.CHATML)(m=t)]
    assert "".join(t for t, _ in whole) == "".join(t for t, _ in parts)
    assert [t for t, masked in whole if masked] == ["yo\\\\"]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "user", "n"), (3, None, None, "x"), (3, 0, "assistant", "é🙂"), (3, 0, "assistant", "é🙂")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss_spans")
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.rendered(chat.in_order(df))).collect()}
    assert set(got) == {1, 2, 3, 9, None}
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        size = sum(len(chat.escape(r[2] or "")) + len(chat.escape(r[3] or "")) + 24 for r in mine)
        assert got[conv] == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    assert chat.digests(chat.rendered(chat.in_order(df.limit(0)))).count() == 0


def test_changed_texts_keep_their_name():
    scanner = licenses.Scanner(licenses.notices())
    by_name = {}
    for name, text in licenses.TEXTS:
        if name in ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MIT", "Zlib", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
            by_name[name] = max(by_name.get(name, ""), text, key=len)
    for name, text in by_name.items():
        w = text.split()
        for at in (0.3, 0.5, 0.7, 0.9):
            k = int(at * len(w))
            changed = " ".join([*w[:k], "the", "Foo", "Corporation", *w[k + 3 :]])
            best = max(scanner.scan(f"Copyright 2020 Foo. {changed} And more of it."), key=lambda x: x[3] - x[2])
            assert best[0] == name, (name, at, best)
    assert [x[0] for x in scanner.scan(licenses._BSD_HEAD)] == ["BSD"]


def test_runs_of_marks_are_looked_up():
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    counter = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a " + "'" * 70 + "s it's", "'" * 33 + "!'ll", " ''''ve'", "x" + "'!" * 30):
        table = tokens.PrefixTable(counter, text)
        n = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [table.at(i) for i in range(len(text) + 1)] == n
        assert all(table.longest_within(b) == max(i for i, x in enumerate(n) if x <= b) for b in range(max(n) + 1))
    began = time.time()
    table = tokens.PrefixTable(counter, "'" * 20_000)
    assert 0 < table.longest_within(200) < 20_000 and time.time() - began < 5
