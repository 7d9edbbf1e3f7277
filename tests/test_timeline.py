from __future__ import annotations

import random

import pytest

from shotweave.operators import timeline
from shotweave.params import Params, Shots, fingerprint, layered, replaced


def frames(spark, probs, video="v"):
    return spark.createDataFrame([(video, i, float(p)) for i, p in enumerate(probs)], "video string, frame long, prob double")


def cut_list(df, column="cut"):
    return sorted(r[column] for r in df.collect())


def cuts_by_hand(probs, threshold):
    """One cut in the middle of each run of frames strictly above the threshold, if it is inside the video."""
    out, first = [], None
    for frame, p in enumerate([*probs, threshold]):
        if p > threshold and first is None:
            first = frame
        elif p <= threshold and first is not None:
            cut = (first + frame + 1) // 2
            out += [cut] if 0 < cut < len(probs) else []
            first = None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cuts_of_random_signals(spark, seed):
    rng = random.Random(seed)
    signals = {}
    for v in range(30):
        levels = [0.0, 0.2, 0.35, 0.36, 0.7, 1.0]
        signals[f"v{v}"] = [p for _ in range(rng.randint(1, 12)) for p in [rng.choice(levels)] * rng.choice([1, 1, 2, 5, 9])]
    rows = [(v, i, p) for v, probs in signals.items() for i, p in enumerate(probs)]
    got: dict = {}
    for r in timeline.cuts(spark.createDataFrame(rows, "video string, frame long, prob double"), 0.35).collect():
        got.setdefault(r.video, []).append(r.cut)
    assert {v: sorted(c) for v, c in got.items()} == {v: c for v, probs in signals.items() if (c := cuts_by_hand(probs, 0.35))}


def merged(cuts, n, least):
    kept = []
    for c in sorted({c for c in cuts if 0 < c < n}):
        if least <= 1 or c - (kept[-1] if kept else 0) >= least:
            kept.append(c)
    while least > 1 and kept and n - kept[-1] < least:
        kept.pop()
    return kept


@pytest.mark.parametrize("least", [1, 4, 9])
def test_merge_short_random(spark, least):
    rng = random.Random(least)
    rows = [(v, rng.randrange(200), 200) for v in range(40) for _ in range(rng.randrange(1, 40))]
    got: dict = {}
    for r in timeline.merge_short(spark.createDataFrame(rows, "video long, cut long, n_frames long"), least).collect():
        got.setdefault(r.video, []).append(r.cut)
    for v in range(40):
        assert sorted(got.get(v, [])) == merged([c for w, c, _ in rows if w == v], 200, least)


def test_shots_cover_the_video(spark):
    cuts = spark.createDataFrame([("v", 25), ("v", 50)], "video string, cut long")
    videos = spark.createDataFrame([("v", 100, 25.0, 4.02), ("w", 10, 25.0, 0.4)], "video string, n_frames long, fps double, duration double")
    rows = timeline.shots_from_cuts(cuts, videos).orderBy("video", "shot").collect()
    assert [(r.video, r.start, r.end) for r in rows] == [("v", 0, 1), ("v", 1, 2), ("v", 2, 4.02), ("w", 0, 0.4)]


def test_sampled_frames_lie_inside(spark):
    shots = spark.createDataFrame([("v", 0, 10, 11), ("v", 1, 11, 50), ("v", 2, 50, 50)], "video string, shot long, start_frame long, end_frame long")
    rows = timeline.sampled_frames(shots, Shots().frame_positions).collect()
    assert {r.frame for r in rows if r.shot == 0} == {10}
    assert [r.frame for r in sorted((r for r in rows if r.shot == 1), key=lambda r: r.pos)] == [11 + int(p * 39) for p in Shots().frame_positions]
    assert {r.frame for r in rows if r.shot == 2} == {49}


def test_nearest_prefers_the_earlier_on_ties(spark):
    left = spark.createDataFrame([("v", 1, 10.0), ("v", 2, 50.0), ("v", 2, 50.0), ("w", 3, 10.0)], "video string, id long, t double")
    right = spark.createDataFrame([("v", 9.0), ("v", 11.0), ("v", 48.1), ("v", 50.4), ("v", 80.0)], "video string, c double")
    got = sorted((r.video, r.id, r.nearest) for r in timeline.nearest(left, "t", right, "c", 2.0, 0.5).collect() if r.nearest is not None)
    assert got == [("v", 1, 9.0), ("v", 2, 50.4), ("v", 2, 50.4)]
    assert timeline.nearest(left, "t", right, "c", 2.0, 0.5).count() == 4


def test_filled_copies_only_the_second_shot_forward(spark):
    rows = [("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("b", 0, None), ("b", 1, None), ("b", 2, 3.0), ("b", 3, None)]
    got = {(r.video, r.shot): r.x for r in timeline.filled(spark.createDataFrame(rows, "video string, shot long, x double"), "x").collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 1.0, ("b", 0): None, ("b", 1): None, ("b", 2): 3.0, ("b", 3): 3.0}


def test_containment(spark):
    shots = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 4.9995), ("v", 2, 5.0), ("v", 3, 9.0)], "video string, shot long, start double")
    scenes = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 5.0)], "video string, segment long, begin double")
    assert {r.shot: r.segment for r in timeline.containment(shots, scenes).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_parameters(tmp_path):
    file = tmp_path / "p.toml"
    file.write_text('[grouping]\nwindow_shots = 4\n[shots]\nframe_positions = [0.5]\n')
    p = layered({"grouping": {"window_shots": 9, "abs_threshold": 0.1}}, file)
    assert (p.grouping.window_shots, p.grouping.abs_threshold, p.shots.frame_positions) == (4, 0.1, (0.5,))
    assert fingerprint(p) != fingerprint(Params()) == fingerprint(Params())
    for bad in ({"grouping": {"nothing": 1}}, {"nobody": {}}, {"grouping": {"depth_mode": "up"}}, {"unique": {"linkage": "ward"}}):
        with pytest.raises(ValueError):
            layered(bad)
    with pytest.raises(ValueError):
        replaced(Params().grouping, clip_weight=0.0, color_weight=0.0)
    assert timeline.min_frames(0.4, 25.0) == 10 and timeline.min_frames(0.001, 25.0) == 1


def test_detectors_by_name(spark):
    df = frames(spark, [1.0] * 20 + [30.0] + [1.0] * 19)
    assert cut_list(timeline.adaptive_cuts(df)) == [20]
    videos = spark.createDataFrame([("v", 40, 10.0, 4.0)], "video string, n_frames long, fps double, duration double")
    assert timeline.detected_shots(df, videos, "adaptive", 3.0, 2).count() == timeline.detected_shots(df, videos, "threshold", 3.0, 2).count() == 2
    with pytest.raises(ValueError):
        timeline.detected_shots(df, videos, "oracle", 3.0, 2)


def test_parameters_round_trip(tmp_path):
    from shotweave.params import to_toml

    p = layered({"grouping": {"window_shots": 3}, "shots": {"frame_positions": [0.1, 0.9]}})
    (tmp_path / "p.toml").write_text(to_toml(p))
    assert layered(tmp_path / "p.toml") == p
