"""The classifier, decontamination, mixing and the pipeline of stages."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shotweave.llm import decontam, mixing, quality

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_on_held_out_rows(spark):
    rng = random.Random(0)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(3, 200))) + "."
    bad = lambda: " ".join("".join(rng.choice("ETAOIN") for _ in range(5)) + rng.choice(["!!", "$$$", " |"]) for _ in range(rng.randint(3, 200)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, "null id"), (902, "x " * 50_000), (5, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS stats", "3 AS y")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(400)] + [(7, None, 0), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5 and r.held_out]
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in out) >= 0.97 * len(out) > 50


def scores_by_hand(rows, labels):
    """The classifier over plain arrays: statistics, scaling, random features, ridge by normal equations, isotonic levels by
    cells; features, widths and penalties are the operator's parameters."""
    data = [(t or "").encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, data)])
    x = quality.statistics(np.frombuffer(b"".join(data), np.uint8), offsets)
    learn = [k for k, (i, _) in enumerate(rows) if i in labels and zlib.crc32(str(i).encode()) % 5]
    y = np.array([labels[rows[k][0]] for k in learn], float)
    mean, spread = x[learn].mean(0), x[learn].std(0)
    scaled = np.clip((x - mean) / np.where(spread > 1e-9, spread, 1.0), -8, 8)
    rng = np.random.default_rng(quality.SEED)
    frequencies = rng.standard_normal((x.shape[1], quality.N_FEATURES)) / quality.WIDTH
    phases = rng.uniform(0, 2 * np.pi, quality.N_FEATURES)
    z = np.hstack([np.sqrt(2 / quality.N_FEATURES) * np.cos(scaled @ frequencies + phases), np.ones((len(x), 1))])
    m = z.shape[1]
    penalty = quality.RIDGE * max(1.0, len(learn)) / m * np.eye(m)
    penalty[-1, -1] = 0
    w = np.linalg.solve(z[learn].T @ z[learn] + penalty + 1e-9 * np.eye(m), z[learn].T @ y)
    raw = z @ w
    cell = np.clip(((raw[learn] + 1) / 3 * quality.CELLS).astype(int), 0, quality.CELLS - 1)
    used = np.unique(cell)
    value, weight = np.array([y[cell == c].mean() for c in used]), np.array([(cell == c).sum() for c in used])
    # The isotonic fit by its minimax formula.
    n = len(used)
    mean_of = lambda a, b: float((value[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum())
    levels = [max(min(mean_of(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    return np.clip(np.interp(raw, (used + 0.5) / quality.CELLS * 3 - 1, levels), 0, 1)


def test_quality_fit_matches_numpy(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "Zebra", "!!", "<b>", "42", "naïve", "x", "\n", "long" * 9]
    rows = [(i, None if i == 7 else " ".join(rng.choice(vocabulary[: 4 + i % 7]) for _ in range(rng.randint(0, 120)))) for i in range(260)]
    marks = {i: int((i % 7 < 3) ^ (rng.random() < 0.1)) for i in range(220)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int")).collect()}
    want = scores_by_hand(rows, marks)
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-5)
    assert len(set(np.round(want, 4))) > 5


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(df, none).collect()] == [1.0, 1.0]
    assert quality.quality_scores(df.limit(0), none).count() == 0


def test_features_approximate_the_kernel():
    x = np.random.default_rng(0).standard_normal((40, 5))
    z = quality.fourier(x, 20_000, 2.0, 1)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - want).max() < 0.06


def test_pool_adjacent():
    got = quality.pool_adjacent(np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 3]))
    assert got.tolist() == pytest.approx([1, 2.25, 2.25, 2.25, 4.25, 4.25])


BENCH = [(1, "A farmer named John Smith sold 12 kg of apples to the market and then 12 kg of pears before noon"), (2, "plain words only that nobody else would ever write in this exact order at all"), (3, "short one"), (4, None), (None, "null item with a few more words than the window has")]


def test_decontamination(spark):
    item = BENCH[1][1]
    rows = [
        (1, "Intro text. A farmer named Mary Jones sold 7 kg of apples to the market and then 7 kg of pears before noon. More."),  # other values, consistent
        (2, "A farmer named Mary Jones sold 7 kg of apples to the market and then 9 kg of pears before noon"),  # one slot, two values
        (3, f"zz {item}"), (4, None), (5, ""), (None, item), (6, f"{item} {item}"), (6, f"{item} {item}"),
        (7, "plain words only that nobody liked but other words follow here and so on and on"), (8, "lead in " * 5000 + item.replace(" ", "\n\t")),
        (9, "John Smith 12 kg Apples 3 Bob"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS pos", "3 AS tokens", "4 AS h")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_changed > 0) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): True, (3, 2): False, (6, 2): False, (8, 2): False, (None, 2): False}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 5, 7, 9], key=str)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_a_variant_does_not_hide_the_item(spark):
    variant = "A farmer named Mary Jones sold 7 kg of apples to the market and then 9 kg of pears before noon"
    rows = [(1, f"{variant}. {BENCH[0][1]}. More."), (2, f"{BENCH[0][1]}. {variant}."), (3, f"{variant}. {variant}."), (4, f"{variant}. And {variant}. Later, {BENCH[0][1]}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_changed) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (4, 1, 0)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [3]


def test_long_runs_of_names_and_numbers(spark):
    item = BENCH[1][1]
    rows = [(i, f"so {run}. Then {item}") for i, run in enumerate((" ".join(["Word"] * 20_000), ".".join(["12"] * 20_000), "A" + "b" * 20_000))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(0, 2), (1, 2), (2, 2)]


SHORT = [(1, "What is 2 + 2?"), (2, "12 kg, 13 kg, 14 kg, 15 kg, 16 kg."), (3, "答案是什么样的东西呢"), (4, "Paris"), (5, "It is Anna Smith Jones"), (6, "a b c d e f g h i j k l m n o p q r s t")]


def test_short_and_slot_heavy_items(spark):
    rows = [
        (1, "Ask: what is 2+2 ?"), (2, "what is 2 and 2"), (3, "12 kg 13 KG; 14 kg, 15 kg; 16 kg and more"), (4, "12 kg 13 kg 14 kg 15 kg 17 kg"), (5, "前文，答案是什么样的东西呢。后文"), (6, "Paris is Paris"), (7, "so it is Anna Smith Jones"),
        (8, "x y c d e f g h i j k l m n o z z"), (9, "x y c d e f g h i j z z"), (10, None), (11, "what is 2 + 2"), (11, "other text"), (None, "What is 2 2"), (None, "clean"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(SHORT, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_literal for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): 1, (3, 2): 1, (5, 3): 1, (7, 5): 1, (8, 6): 1, (11, 1): 1, (None, 1): 1}
    kept = decontam.drop_contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(2, "what is 2 and 2"), *[(i, t) for i, t in rows if i in (4, 6, 9, 10)], (11, "other text")]
    assert [r.text for r in kept if r.doc_id is None] == ["clean"]


def test_sql_gives_the_same_pairs_and_mixture(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    texts = [
        "Then a farmer named Mary Jones sold 7 kg of apples to the market and then 7 kg of pears before noon. More.", "A farmer named Mary Jones sold 7 kg of apples to the market and then 9 kg of pears before noon", BENCH[0][1], BENCH[1][1] + " 12 kg", "", None,
        "Later, John Smith and Mary sold 12 kg of apples to the market and then 12 t of pears before noon", "A farmer named Ann sold 1,200.5 kg of apples to the market and then 1,200.5 kg of pears before noon",
    ]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", BENCH)
    variant = texts[1]
    texts += [f"{variant}. {BENCH[0][1]}. More.", f"{BENCH[0][1]}. {variant}.", f"{variant}. {variant}.", "zz short ONE.", "Mary, " + " ".join(BENCH[1][1].split()[:13])]
    rows = [(i, t, "en", f"s{i % 3}" if i else None, 0) for i, t in enumerate(texts)] + [(2, "again, " + BENCH[0][1], "en", "s", 0)]
    docs = docs_of(spark, rows)
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    for df, sql in ((decontam.contaminated(docs, bench), decontam.SQL), (mixing.mixed(docs), mixing.SQL)):
        want = con.sql(sql)
        got = sorted(tuple(r[c] for c in want.columns) for r in df.collect())
        assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in sorted(want.fetchall())] and got


def test_broadcast_and_shuffled_joins_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == one
    texts = {r.doc_id: r.text for r in docs.collect()}
    planted = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if b.text in t}
    assert planted and planted <= {(r[0], r[1]) for r in one}


@pytest.mark.parametrize("window", [1, 2, 3, 5, 7, 8, 13])
def test_windows_have_equal_hashes_only_if_equal(spark, window):
    rng = random.Random(window)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 20))]) for i in range(30)]
    got = decontam.windows(spark.createDataFrame(rows, "id long, tokens array<string>"), window).collect()
    tokens = dict(rows)
    by_hash: dict[int, set] = {}
    for r in got:
        by_hash.setdefault(r.h, set()).add(tuple(tokens[r.id][r.pos : r.pos + window]))
    assert all(len(v) == 1 for v in by_hash.values())
    assert sorted((r.id, r.pos) for r in got) == [(i, p) for i, t in sorted(rows) for p in range(max(0, len(t) - window + 1))]
    assert len(by_hash) == len({tuple(t[p : p + window]) for _, t in rows for p in range(max(0, len(t) - window + 1))})


def mix_rows(n=600):
    rng = random.Random(3)
    return [(i, "w " * rng.randint(0, 40), "en", "big" if i % 2 else f"s{i % 12}", 0) for i in range(n)]


def test_mixing_meets_quotas(spark):
    docs = docs_of(spark, mix_rows())
    rows = mixing.mixed(docs, max_repetition=1.5, per_block=16).collect()
    tokens: dict[str, int] = {}
    for _, text, _, source, _ in mix_rows():
        tokens[source] = tokens.get(source, 0) + len(text.split()) + 1
    used: dict[str, int] = {}
    weights: dict[str, float] = {}
    seen: dict[str, dict] = {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
        weights[r.source] = r.weight
        seen.setdefault(r.source, {}).setdefault(r["pass"], set()).add(r.doc_id)
    assert sum(weights.values()) == pytest.approx(1, abs=1e-6)
    budget = min(tokens[s] / weights[s] for s in tokens) * 0 + max(tokens[s] / weights[s] for s in tokens)
    for s in tokens:
        assert 0 <= used[s] - weights[s] * budget < 42 or abs(used[s] - weights[s] * budget) < 1
        assert used[s] <= 1.5 * tokens[s] + 42
        assert seen[s][0] >= seen[s].get(1, set())
    assert {r.doc_id for r in rows} == {r[0] for r in mix_rows()}


def test_mixing_exponent_for_entropy(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    a, z, _ = mixing.exponent(shares, target_entropy=1.0, budget_ratio=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** a / z
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-5)
    assert mixing.exponent(shares, target_entropy=9.0, budget_ratio=1.0)[0] == 0.0
    assert mixing.exponent(shares, max_repetition=100.0)[0] == 0.0


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "x", 3), (2, "w " * 100_000, "en", "x", 1)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS block", "2 AS weight", "3 AS tokens")
    got = mixing.mixed(docs, budget_ratio=1.0, target_entropy=0.0).collect()
    assert sorted((str(r.doc_id), r.source, r.n_tokens) for r in got) == [("1", "", 1), ("1", "", 1), ("2", "x", 100_001), ("None", "x", 3)]
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        assert len(rows) == len({r.doc_id for r in rows}) <= at.count()
        kept.append(rows)
        at = spark.createDataFrame(rows, docs.schema)
    texts = [" ".join(r.text.split()) for r in kept[1]]
    assert len(texts) == len(set(texts)) and set(texts) == {" ".join(r.text.split()) for r in kept[0]}
    assert {r.doc_id for r in kept[2]} - {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if any(b in r.text for b in bench)}
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept[3]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in kept[3]}
