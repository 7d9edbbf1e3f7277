"""Tuning, acceptance, ranked sums, splits, stored tables and streams against plain computations."""

from __future__ import annotations

import dataclasses
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scenes import SHOTS, P, reel

from shotweave.operators import boxes, coherence, context, diagnose, labels, learn, metrics, scenes, tune
from shotweave.sources import files


def videos_of(spark, n):
    rows, truth = [], []
    for v in range(n):
        mine, starts = reel(40 + v, [4 + v, 6, 5], n_views=1 + v % 3)
        rows += [(f"v{v}", *r[1:]) for r in mine]
        truth += [(f"v{v}", mine[k][2]) for k in starts[1:]]
    return spark.createDataFrame(rows, SHOTS), spark.createDataFrame(truth, "video string, time double")


def test_grids_give_what_separate_runs_give(spark):
    shots, truth = videos_of(spark, 3)
    settings = tune.grid(window_seconds=[9.0, 45.0], clip_weight=[0.2, 0.9], min_scene_seconds=[3.0, 30.0])
    assert all(s["color_weight"] == pytest.approx(1 - s["clip_weight"]) for s in settings)
    got: dict = defaultdict(dict)
    for r in tune.judged(shots, truth, P, settings).collect():
        got[r.setting][r.video] = r.f1
    videos = scenes.durations(shots)
    for n in (0, 3, 5, 6):
        p = dataclasses.replace(P, **settings[n])
        said = scenes.cut_decisions(shots, p).where("decision = 'boundary'").select("video", "time")
        want = {r.video: r.f1 for r in metrics.prf(said, truth, videos, (2.0,)).collect()}
        assert got[n] == pytest.approx(want)
    assert len({tuple(sorted(f.items())) for f in got.values()}) > 1


def test_settings_that_choose_alike_share_a_matching(spark, monkeypatch):
    shots, truth = videos_of(spark, 3)
    settings = [*tune.grid(abs_threshold=[2.0 + k / 10 for k in range(20)], min_scene_seconds=[3.0, 30.0]), {}]  # scores are at most 1, so all but the last choose nothing
    matched, plain = [], metrics.prf

    def counted(pred, truth, *rest):
        matched.append(truth.count())
        return plain(pred, truth, *rest)

    monkeypatch.setattr(metrics, "prf", counted)
    got = {(r.setting, r.video): r.f1 for r in tune.judged(shots, truth, P, settings).collect()}
    assert set(got) == {(n, f"v{v}") for n in range(len(settings)) for v in range(3)}
    assert all(got[n, v] == 0 for n, v in got if n < 40) and any(got[40, f"v{v}"] > 0 for v in range(3))
    assert matched == [2 * truth.count()]  # not 41 times


def test_stretches_of_cuts_give_what_whole_videos_give(spark, monkeypatch):
    shots, _ = videos_of(spark, 3)
    monkeypatch.setattr(coherence, "PART_CUTS", 3)
    settings = tune.grid(window_shots=[1, 3, 6], coherence_topk=[1, 2, 3], depth_mode=["climb", "window"], window_seconds=[9.0, 45.0])
    got = defaultdict(dict)
    for r in coherence.grid_scores(shots, [dataclasses.replace(P, **x) for x in settings]).collect():
        assert (r.video, r.cut) not in got[r.scored]
        got[r.scored][r.video, r.cut] = (r.time, r.score, r.depth)
    for n in (0, 7, 14, 21, 27, 34):
        p = dataclasses.replace(P, **settings[n])
        want = coherence.depths(coherence.coherence(coherence.pair_similarities(shots, p), shots, p), p)
        want = {(r.video, r.cut): (r.time, r.score, r.depth) for r in want.collect()}
        assert set(got[n]) == set(want) and all(got[n][k] == pytest.approx(want[k]) for k in want)


def test_leaving_videos_out(spark):
    f1 = [[0.5, 0.9, 0.1, 0.3], [0.6, 0.2, 0.6, 0.6], [0.6, 0.2, 0.6, 0.6]]
    rows = [(s, f"v{v}", x) for s, line in enumerate(f1) for v, x in enumerate(line)]
    figures = spark.createDataFrame(rows, "setting long, video string, f1 double")
    got = {r.video: (r.setting, r.f1) for r in tune.leave_one_out(figures).collect()}
    assert got == {f"v{v}": (s, f1[s][v]) for v, s in enumerate([1, 1, 0, 0])}
    assert tune.leave_one_out(figures.where("video < 'v2'")).count() == 0
    assert [(r.setting, r.place) for r in tune.tuned(figures).orderBy("place").collect()] == [(1, 1), (2, 2), (0, 3)]


@pytest.mark.parametrize(("dev", "val", "ok"), [((0.7, 0.7), (0.5,), True), ((0.7, 0.7), (0.4,), False), ((0.5, 0.5), (0.9,), False), ((0.9, 0.4), (), False), ((0.7, 0.7), (), True)])
def test_acceptance(spark, dev, val, ok):
    rows = [("rule", "dev", f"d{i}", 0.5) for i in range(len(dev))] + [("rule", "val", f"w{i}", 0.5) for i in range(len(val))]
    rows += [("new", "dev", f"d{i}", x) for i, x in enumerate(dev)] + [("new", "val", f"w{i}", x) for i, x in enumerate(val)]
    got = {r.method: r.accepted for r in learn.accepted(spark.createDataFrame(rows, "method string, part string, video string, f1 double"), "rule").collect()}
    assert got == {"rule": None, "new": ok}


def ranked_rows(n=900):
    rng = random.Random(6)
    return [(f"g{i % 3}", round(rng.gauss(0, 1), 2) if i % 3 else rng.choice([0.1, 0.2]), rng.random() < 0.3) for i in range(n)]


def test_sums_in_ranges_match_plain_ones(spark):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    auc, ap, best = ({r.g: r for r in f(df, "s", "y", ["g"]).collect()} for f in (diagnose.rank_auc, diagnose.average_precision, diagnose.best_threshold))
    for g in ("g0", "g1", "g2"):
        mine = [(s, y) for k, s, y in rows if k == g]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        assert auc[g].auc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        precision = {t: np.mean([y for s, y in mine if s >= t]) for t in set(pos)}
        assert ap[g].ap == pytest.approx(np.mean([precision[s] for s in pos]))
        values = sorted({s for s, _ in mine})
        f1 = {(a + b) / 2: 2 * sum(s > a for s in pos) / (sum(s > a for s, _ in mine) + len(pos)) for a, b in zip(values, values[1:])}
        assert best[g].f1 == pytest.approx(max(f1.values()))
        assert best[g].threshold == pytest.approx(min(t for t, x in f1.items() if x == max(f1.values())))
    assert diagnose.rank_auc(df, "s", "y", []).first().n == len(rows)


def test_held_out_thresholds_are_the_best_of_the_others(spark, monkeypatch):
    """Against every cut of every other group, with ties, scores of one group only and one score in all; and no table has a row for each group and score."""
    rng = np.random.default_rng(3)
    rows = []
    for by, groups, levels in (("a", 25, 400), ("b", 3, 4), ("c", 2, 1), ("d", 6, 100_000)):
        for g in range(groups):
            for _ in range(int(rng.integers(1, 30))):
                x = float(rng.integers(levels)) / 8 + (g == 1) * 1000 * (by == "b")
                rows.append((by, g, x, bool(rng.random() < 0.2 + 0.5 * x / (levels / 8))))
    df = spark.createDataFrame(rows, "by string, g int, x double, y boolean")
    sizes = []
    kept = diagnose.materialised
    monkeypatch.setattr(diagnose, "materialised", lambda df, name: (out := kept(df, name), sizes.append(out.count()))[0])
    got = {(r["by"], r.g): (r.low, r.high) for r in diagnose._best_of_the_others(df, "x", "y", "g", ["by"], True).collect()}
    assert max(sizes) <= len(rows)
    for by, g in {r[:2] for r in rows}:
        others = [(x, y) for b, o, x, y in rows if b == by and o != g]
        scores = sorted({x for x, _ in others})
        positive = sum(y for _, y in others)
        f1 = lambda t: 2 * sum(y for x, y in others if x > t) / (sum(x > t for x, _ in others) + positive)
        best = max(range(len(scores) - 1), key=lambda i: (f1(scores[i]), -i), default=None)
        assert got[by, g] == ((scores[0], None) if best is None else (scores[best], scores[best + 1])), (by, g)
    cut = {(r["by"], r.g): r["cut"] for r in diagnose.left_out_threshold(df, "x", "y", "g", ("by",)).collect()}
    for by, g in {r[:2] for r in rows}:
        others = [(x, y) for b, o, x, y in rows if b == by and o != g]
        f1 = lambda t: 2 * sum(y for x, y in others if x >= t) / (sum(x >= t for x, _ in others) + sum(y for _, y in others))
        assert cut[by, g] == min({x for x, _ in others}, key=lambda t: (-f1(t), t)), (by, g)


def test_thresholds_of_the_others(spark):
    rows = ranked_rows(300)
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r["cut"] for r in diagnose.left_out_threshold(df, "s", "y", "g").collect()}
    for g in ("g0", "g1", "g2"):
        rest = [(s, y) for k, s, y in rows if k != g]
        n_pos = sum(y for _, y in rest)
        f1 = {t: round(2 * sum(y for s, y in rest if s >= t) / (sum(s >= t for s, _ in rest) + n_pos), 12) for t in {s for s, _ in rest}}
        assert got[g] == min(t for t, x in f1.items() if x == max(f1.values()))


def test_taking_turns(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"k{rng.randrange(90)}", i) for i in range(700)]
    got = {(r.s, r.i): r.place for r in diagnose.round_robin(spark.createDataFrame(rows, "s string, k string, i long"), "s", "k", ["i"], 40).collect()}
    want = {}
    for s in "ab":
        turns, seen = [], defaultdict(int)
        for _, k, i in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            seen[k] += 1
            turns.append((seen[k], k, i))
        want |= {(s, i): place for place, (_, _, i) in enumerate(sorted(turns)[:40], 1)}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_splits_have_their_share(spark, n):
    names = spark.range(n).select(F.concat(F.lit("n"), "id").alias("stem"))
    roles = {r.role: r["count"] for r in labels.deterministic_split(names, 5).groupBy("role").count().collect()}
    assert roles.get("test", 0) == max(round(0.3 * n), int(n >= 2)) and sum(roles.values()) == n


def test_contexts_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    clips, vectors = rng.standard_normal((20, 6)), rng.standard_normal((9, 6))
    names = [f"c{k % 4}" for k in range(9)]
    shots = spark.createDataFrame([("v", i, c.tolist()) for i, c in enumerate(clips)], "video string, shot long, clip array<double>")
    prompts = spark.createDataFrame([(names[k], k, v.tolist()) for k, v in enumerate(vectors)], "context string, prompt long, vec array<double>")
    z = np.array([[max(2.0 * float(c @ v) for n, v in zip(names, vectors) if n == name) for name in sorted(set(names))] for c in clips])
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for most in (10_000, 3):
        monkeypatch.setattr(context, "MOST_PROMPTS", most)
        got = {(r.shot, r.context): r.p for r in context.facet_probabilities(shots, prompts, 2.0).collect()}
        assert got == pytest.approx({(i, f"c{k}"): want[i, k] for i in range(20) for k in range(4)})


def test_prompts_have_a_name(spark):
    import hashlib
    import json

    rows = [(2, "mug", ["a mug", 'a "tall" mug']), (1, "lamp", ["a lamp"])]
    pairs = [["a lamp", "lamp"], ["a mug", "mug"], ['a "tall" mug', "mug"]]
    got = boxes.prompts_hash(spark.createDataFrame(rows, "place long, type_id string, prompts array<string>")).first()[0]
    assert got == hashlib.sha1(json.dumps(pairs).encode()).hexdigest()[:10]


def test_replacing_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(5), path)
    files.replace_table(spark.read.parquet(path).where("id > 1"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="broken"):
        files.replace_table(spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3


def test_shots_of_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video": "a", "shots": [{"index": 0, "start_frame": 0, "end_frame": 50, "start": 0.0, "end": 2.0}, {"index": 1, "start_frame": 50, "end_frame": 80, "start": 2.0, "end": 3.2}], "more": 1}')
    assert [tuple(r) for r in files.read_shots(spark, str(tmp_path)).orderBy("shot").collect()] == [("a", 0, 0, 50, 0.0, 2.0), ("a", 1, 50, 80, 2.0, 3.2)]


def test_sessions_of_a_folder_of_files(spark, tmp_path):
    from shotweave.plans.streams import batch_sessions, stream_sessions

    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    told = {tuple(r) for r in stream_sessions(spark, str(tmp_path)).collect()}
    every = {tuple(r) for r in batch_sessions(spark, str(tmp_path)).collect()}
    last = whole.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    # The watermark is an hour behind the last event; what ends before it is closed.
    closed = {r for r in every if (last - r[2]).total_seconds() > 3600}
    assert told == closed and 0 < len(told) <= len(every)


def test_held_out_thresholds_and_combinations(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(360):
        y = bool(rng.random() < 0.4)
        rows.append((f"v{k % 4}", k, y, round(float(rng.normal(y, 1)), 2), round(float(rng.normal(0.6 * y, 1)), 2), 0.5))
    df = spark.createDataFrame(rows, "video string, k long, y boolean, a double, b double, flat double")
    got = {r.measure: r for r in diagnose.measure_study(df, ["a", "b", "flat"], "y", "video").collect()}
    for at, name in ((3, "a"), (4, "b"), (5, "flat")):
        tp = fp = fn = 0
        for v in range(4):
            rest = [(r[at], r[2]) for r in rows if r[0] != f"v{v}"]
            values = sorted({x for x, _ in rest})
            tries = [(p + q) / 2 for p, q in zip(values, values[1:])] or values
            f1 = lambda t: 2 * sum(y for x, y in rest if x >= t) / (sum(x >= t for x, _ in rest) + sum(y for _, y in rest))
            cut = max(tries, key=lambda t: (f1(t), -t))
            for r in (r for r in rows if r[0] == f"v{v}"):
                tp, fp, fn = tp + (r[at] >= cut and r[2]), fp + (r[at] >= cut and not r[2]), fn + (r[at] < cut and r[2])
        assert got[name].held_out_f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert got["flat"].threshold == 0.5


def test_combinations_are_models_of_the_other_groups(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 2)), rng.random(200) < 0.5
    x[:, 0] += y
    rows = [(f"v{k % 5}", k, bool(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "film string, k long, same boolean, a double, b double")
    got = {r.k: r["a+b"] for r in diagnose.combined(df, {"a+b": ["a", "b"]}, "same", "film", ["k"]).collect()}
    for v in range(5):
        on = np.arange(200) % 5 != v
        b, z = np.zeros(3), np.column_stack([np.ones(200), x])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[on] @ b))
            b = b - np.linalg.solve((z[on] * (p * (1 - p))[:, None]).T @ z[on] + np.diag([0.0, 1, 1]), z[on].T @ (p - y[on]) + np.array([0, b[1], b[2]]))
        for k in np.flatnonzero(~on):
            assert got[k] == pytest.approx(1 / (1 + np.exp(-z[k] @ b)), abs=1e-7)
