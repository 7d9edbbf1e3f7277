from __future__ import annotations

import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.operators import boxes, context, diagnose, labels, learn, review
from shotweave.params import Grouping
from shotweave.sources import files, media

BOX = "scene long, det long, type_id string, grp string, score double, x1 double, y1 double, x2 double, y2 double, shot long, base double"


def overlap(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    shared = max(0.0, w) * max(0.0, h)
    return shared / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - shared)


def kept_by_hand(rows, same, group, any_):
    kept = []
    for d in sorted(rows, key=lambda r: (-r[4], r[1])):
        for k in kept:
            o = overlap(d, k)
            if (d[2] == k[2] and o > same) or (d[3] == k[3] and d[3] and o > group) or o > any_:
                break
        else:
            kept.append(d)
    return sorted(r[1] for r in kept)


@pytest.mark.parametrize(("operator", "limits"), [(boxes.suppressed, (0.5, 0.6, 0.85)), (boxes.merged_frames, (0.3, 0.5, 0.85))])
def test_overlapping_boxes_match_a_plain_choice(spark, operator, limits):
    rng = np.random.default_rng(12)
    rows = []
    for scene in range(12):
        at = rng.uniform(0.1, 0.6, (4, 2))
        for det in range(14):
            x, y = at[rng.integers(4)] + rng.uniform(-0.06, 0.06, 2)
            w, h = rng.uniform(0.2, 0.3, 2)
            kind = int(rng.integers(4))
            rows.append((scene, det, f"kind{kind}", ["", "", "pair", "pair"][kind], float(rng.choice([0.3, 0.5, 0.7, 0.9])), float(x), float(y), float(x + w), float(y + h), 0, 1.0))
    got: dict = {}
    for r in operator(spark.createDataFrame(rows, BOX), ["scene"]).collect():
        got.setdefault(r.scene, []).append(r.det)
    want = {scene: kept_by_hand([r for r in rows if r[0] == scene], *limits) for scene in range(12)}
    assert {k: sorted(v) for k, v in got.items()} == want and 12 < sum(map(len, want.values())) < len(rows)


def test_size_rises_to_a_hundredth_and_fades_above_six_tenths(spark):
    areas = [0.0, *np.linspace(0.0004, 0.98, 60).tolist()]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in areas], "a double").select(boxes.size_score(F.col("a"))).collect()]
    want = [0 if a <= 0 else min(1.0, (a / 0.01) ** 0.5) * (max(0.3, 1 - (a - 0.6) / 0.4 * 0.7) if a > 0.6 else 1) for a in areas]
    assert got == pytest.approx(want)


def test_candidates_and_why_they_are_hidden(spark):
    # kind, score, half the side of a square box in the middle, base, tier
    kinds = {"lamp": (0.55, 0.2, 0.9, 0.5), "rug": (0.45, 0.25, 0.9, 0.5), "vase": (0.95, 0.006, 0.6, None), "desk": (0.41, 0.3, 1.0, 0.1), "cup": (0.39, 0.3, 1.0, 0.1)}
    rows = [(6, i, k, "", c, 0.5 - r, 0.5 - r, 0.5 + r, 0.5 + r, shot, b) for i, (k, (c, r, b, _)) in enumerate(kinds.items()) for shot in range(2 if k == "desk" else 1)]
    tiers = spark.createDataFrame([(k, t) for k, (*_, t) in kinds.items()], "type_id string, tier double")
    got = {r.type_id: r for r in boxes.candidates(spark.createDataFrame(rows, BOX), tiers, 0.4, 0.45).collect()}
    weak, dull = "low detector confidence", "low commercial relevance"
    assert {k: v.hidden_reason for k, v in got.items()} == {"lamp": None, "rug": weak, "vase": dull, "desk": None, "cup": weak}
    assert got["desk"].seen == 2 and got["desk"].max_instances == 1
    shown = sorted((v for v in got.values() if v.displayed), key=lambda v: -v.relevance * v.score)
    assert [v.place for v in shown] == [1, 2] and all(v.place > 2 for v in got.values() if not v.displayed)


def test_credit_goes_to_every_repeat(spark):
    units = {"U1": (5, 7, 8), "U2": (6, 10), "U3": (9,)}
    det = spark.createDataFrame([(2, "U1", 5, "lamp"), (2, "U2", 10, "lamp"), (2, "U3", 9, "rug")], "scene long, unit string, rep_shot long, type_id string")
    occ = spark.createDataFrame([(2, u, s, s * 3.0, s * 3.0 + 3) for u, shots in units.items() for s in shots], "scene long, unit string, shot long, start double, end double")
    rows = boxes.credited(det, occ).orderBy("type_id", "shot").collect()
    assert [(r.type_id, r.shot, r.unit, r.detected) for r in rows] == [
        ("lamp", 5, "U1", True), ("lamp", 6, "U2", False), ("lamp", 7, "U1", False), ("lamp", 8, "U1", False), ("lamp", 10, "U2", True), ("rug", 9, "U3", True),
    ]


def test_keys_and_crops(spark):
    row = spark.createDataFrame([("car", "e7", 0.1, 0.2, 0.3, 0.4)], "type_id string, frame_hash string, x1 double, y1 double, x2 double, y2 double")
    key = row.select(boxes.candidate_key(F.col("type_id"), F.col("frame_hash"), [F.col(c) for c in ("x1", "y1", "x2", "y2")])).first()[0]
    assert key == hashlib.sha1(b"car|e7|[0.1, 0.2, 0.3, 0.4]").hexdigest()[:12]
    r = boxes.crop(row, 1000, 500).first()
    assert 0 <= r.left < 100 and 300 < r.right <= 1000 and r.bottom - r.top >= 64


def test_venues(spark):
    rng = np.random.default_rng(0)
    v = {c: (x := rng.standard_normal(32)) / np.linalg.norm(x) for c in ("bar", "beach", "blank")}
    prompts = spark.createDataFrame([(c, c, x.tolist()) for c, x in v.items()], "context string, prompt string, vec array<double>")
    rows = [("v", 0, i, float(i), i + 1.0, v["bar"].tolist()) for i in range(4)] + [("v", 1, i, float(i), i + 1.0, v["bar" if i % 2 else "beach"].tolist()) for i in range(4, 8)]
    shots = spark.createDataFrame(rows, "video string, scene long, shot long, start double, end double, clip array<double>")
    p = context.facet_probabilities(shots, prompts)
    votes = context.venue_votes(p, shots, prompts.select("context").where("context <> 'blank'"))
    got = {r.scene: r.venue for r in context.gated(votes, 0.6, 0.15, 0.1).collect()}
    assert got == {0: "bar", 1: None}
    assert context.ranked(votes).where("scene = 1").count() == 2
    assert {r.scene: r.environment for r in context.environments(p, shots).collect()} == {0: "bar", 1: None}


def test_review_precision(spark):
    rows = spark.createDataFrame([("a", "correct", 0.8, 0.9), ("b", "correct", 0.5, 0.9), ("c", "wrong", 0.5, 0.9)], "key string, verdict string, confidence double, relevance double")
    assert review.precision(rows, []).first().precision == 0.6667
    sweep = {r.threshold: r.reviewed for r in review.threshold_sweep(rows, 0.45, (0.2, 0.75, 0.9)).collect()}
    assert sweep == {0.2: 3, 0.75: 1, 0.9: 0}
    events = spark.createDataFrame([("a", 1, "correct"), ("a", 2, "wrong"), ("b", 1, "correct"), ("b", 2, "")], "key string, seq long, verdict string")
    assert [(r.key, r.verdict) for r in review.latest(events, ["key"]).collect()] == [("a", "wrong")]
    assert review.precision(rows.limit(0), []).first().precision is None


def test_label_rules(spark):
    rows = [(1, [1.0, 2.0]), (2, []), (3, None), (4, [2.0, 1.0]), (5, [0.0, 1.0]), (6, [1.0, 30.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, b array<double>")
    got = {r.id: r.e for r in df.select("id", labels.label_error(F.col("b"), F.lit(30.0)).alias("e")).collect()}
    assert got == {1: None, 2: "empty", 3: "empty", 4: "not increasing", 5: "not positive", 6: "past the end", 7: "not increasing"}


def replayed_by_hand(ops, cuts, duration, predicted):
    b, neg, pos, refused = sorted(predicted), [], [], 0
    for op, scene, at in ops:
        if op == "clear":
            b = []
        elif op == "reset":
            b, neg, pos = sorted(predicted), [], []
        elif op == "merge":
            if 0 <= scene < len(b):
                neg.append(b.pop(scene))
            else:
                refused += 1
        elif op == "split":
            near = [c for c in cuts if at - 2.0 <= c <= at + 0.5]
            at = round(min(near, key=lambda c: (abs(c - at), c)) if near else at, 3)
            if 0 < at < duration and all(abs(at - x) >= 0.25 for x in b):
                b = sorted([*b, at])
                pos.append(at)
            else:
                refused += 1
    return b, neg, pos, refused


def test_replay_snaps_and_refuses(spark):
    rng = random.Random(5)
    logs, cuts, rows = {}, {}, []
    for v in range(30):
        cuts[v] = sorted(round(rng.uniform(0, 62), 2) for _ in range(rng.randint(0, 12)))
        logs[v] = [(rng.choice(["merge", "split", "split", "split", "clear", "reset", "confirm"]), rng.randint(-1, 4), round(rng.uniform(-3, 66), 1)) for _ in range(rng.randint(1, 12))]
        rows += [(v, seq, *op) for seq, op in enumerate(logs[v])]
    log = spark.createDataFrame(rows, "video long, seq long, op string, scene_index int, at double").withColumns({"predicted": F.array(F.lit(33.0), F.lit(12.5), F.lit(48.0)), "duration": F.lit(60.0)})
    marks = spark.createDataFrame([(v, c) for v, times in cuts.items() for c in times], "video long, time double")
    got = {r.video: tuple(r)[1:] for r in labels.replayed(log, marks).collect()}
    assert got == {v: replayed_by_hand(ops, cuts[v], 60.0, [33.0, 12.5, 48.0]) for v, ops in logs.items()}
    assert sum(r[3] for r in got.values()) > 20


def test_roles(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(10)], "stem string")
    split = labels.deterministic_split(names, 3)
    assert split.where("role = 'test'").count() == 3 and split.collect() == labels.deterministic_split(names, 3).collect()
    assert labels.deterministic_split(names.limit(2), 3).where("role = 'test'").count() == 1
    with pytest.raises(ValueError):
        labels.refuse_leaks(names, names.limit(1))
    labels.refuse_leaks(names.limit(2), names.where("stem = 'n9'"))


def test_auc_and_precision(spark):
    df = spark.createDataFrame([("g", 0.1, False), ("g", 0.4, True), ("g", 0.4, False), ("g", 0.9, True)], "k string, s double, p boolean")
    assert diagnose.rank_auc(df, "s", "p", ["k"]).first().auc == pytest.approx(3.5 / 4)
    assert diagnose.average_precision(df, "s", "p", ["k"]).first().ap == pytest.approx((1 + 2 / 3) / 2)
    best = diagnose.best_threshold(df, "s", "p", ["k"]).first()
    assert (best.threshold, best.f1) == (pytest.approx(0.25), pytest.approx(0.8))


# --- learning ---
def examples(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(6):
        for k in range(30):
            y = int(rng.random() < 0.2)
            rows.append((f"v{v}", k, float(k), y, *[float(x) for x in rng.standard_normal(16) + 2 * y]))
    return spark.createDataFrame(rows, "video string, cut long, time double, label int, " + ", ".join(f"{f} double" for f in learn.FEATURES))


@pytest.mark.parametrize("kind", learn.ESTIMATORS)
def test_models_learn_and_repeat(spark, kind):
    rows = examples(spark)
    scored = learn.out_of_fold(rows, kind, ["video", "cut"], trees=30)
    first = [(r.video, r.cut, r.p) for r in scored.orderBy("video", "cut").collect()]
    assert len(first) == 180
    assert diagnose.rank_auc(scored.withColumn("y", F.col("label") == 1), "p", "y", []).first().auc > 0.9
    again = learn.out_of_fold(rows, kind, ["video", "cut"], trees=30)
    assert [r.p for r in again.orderBy("video", "cut").collect()] == pytest.approx([p for *_, p in first])


def test_probability_selection_and_hybrid(spark):
    rows = [("v", 10.0, 0.9, True), ("v", 12.0, 0.8, False), ("v", 30.0, 0.7, False), ("v", 50.0, 0.2, True), ("v", 70.0, 0.6, False)]
    cuts = spark.createDataFrame(rows, "video string, time double, p double, is_rule boolean").withColumn("duration", F.lit(100.0))
    assert sorted(learn.by_probability(cuts, 0.65, 5.0).first().chosen) == [10.0, 30.0]
    assert sorted(learn.hybrid(cuts, 0.1, 0.75, 5.0).first().chosen) == [10.0, 50.0]
    with pytest.raises(ValueError):
        learn.out_of_fold(examples(spark), "oracle", ["video", "cut"])


def test_artifacts(tmp_path):
    model = {"format_version": 1, "features": list(learn.FEATURES), "coef": [0.1] * 16, "created": "today"}
    path = str(tmp_path / "m.json")
    name = learn.save_artifact(path, model)
    assert learn.load_artifact(path)["artifact_hash"] == name == learn.save_artifact(path, {**model, "created": "later"})
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace("0.1", "0.2", 1))
    with pytest.raises(ValueError):
        learn.load_artifact(path)
    learn.save_artifact(path, {**model, "features": ["score"]})
    with pytest.raises(ValueError):
        learn.load_artifact(path)


def test_features_where_the_place_changes(spark):
    from test_scenes import SHOTS, reel

    rows, starts = reel(1, [6, 6])
    shots = spark.createDataFrame(rows, SHOTS)
    cut = starts[1] - 1
    at = round(rows[starts[1]][2] * 25)
    frames = spark.createDataFrame([("v", i, 0.9 if at - 2 <= i < at + 2 else 0.1) for i in range(at + 600)], "video string, frame long, prob double")
    out = {r.cut: r for r in learn.boundary_features(shots, Grouping(), frames).collect()}
    assert len(out) == 11 and set(learn.FEATURES) < set(out[0].asDict())
    assert out[cut].score == max(r.score for r in out.values()) and (out[cut].trans_peak, out[cut].trans_gradual) == (0.9, 1.0)
    assert out[cut].left_coherence > out[cut].cross_mean < out[cut].right_coherence
    assert out[cut].pace == sum(abs(r[2] - rows[starts[1]][2]) < 15 for r in rows[1:])
    truth = spark.createDataFrame([("v", 16.5), ("v", 60.0)], "video string, time double")
    cuts = spark.createDataFrame([("v", k, 4.0 * (k + 1)) for k in range(7)], "video string, cut long, time double")
    assert [r.cut for r in learn.boundary_labels(cuts, truth).where("label = 1").collect()] == [3]
    assert [r.time for r in learn.unreachable(cuts, truth).collect()] == [60.0]


# --- sources ---
PROBE = "  Duration: 00:01:02.50, start: 0.0\n  Stream #0:0(und): Video: h264 (High), yuv420p, 1280x534, 24.5 fps, 24 tbr\n  Stream #0:1: Audio: aac\n"


def test_probe(spark):
    rows = [("a", PROBE), ("b", PROBE + "displaymatrix: rotation of -90.00 degrees"), ("c", "nothing"), ("d", PROBE.replace("24.5 fps, 24 tbr", ""))]
    got = {r.video: r for r in media.probed(spark.createDataFrame(rows, "video string, text string")).collect()}
    assert (got["a"].duration, got["a"].fps, got["a"].width, got["a"].height, got["a"].has_audio, got["a"].codec) == (62.5, 24.5, 1280, 534, True, "h264")
    assert (got["b"].width, got["b"].height) == (534, 1280)
    assert (got["c"].error, got["d"].error, got["a"].error) == ("no video stream", "no duration or rate", None)
    size = spark.range(1).select(media.scaled_size(F.lit(1280), F.lit(534), 224).alias("s")).first().s
    assert (size.width, size.height) == (538, 224)


def test_names_join_in_any_unicode_form(spark):
    name = "Café"
    a = spark.createDataFrame([(unicodedata.normalize("NFD", name), 1)], "name string, x long")
    b = spark.createDataFrame([(name, 2)], "name string, y long")
    assert a.join(b, "name").count() == 0 and media.join_by_name(a, b, "name").count() == 1


def test_resolution_and_uploads(spark):
    places = spark.createDataFrame([("a", "cache", "c/a"), ("a", "upload", "u/a"), ("b", "video", "v/b")], "stem string, kind string, path string")
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "stem string")
    assert {r.stem: r.kind for r in media.resolved(wanted, places).collect()} == {"a": "upload", "b": "video", "z": "missing"}
    up = spark.createDataFrame([("x/a.MP4", "1"), ("x/b.mp4", "1"), ("x/c.txt", "2")], "path string, video_id string")
    assert [r.path for r in media.accepted_uploads(up).collect()] == ["x/a.MP4"]


def test_content_ids(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 100)
    (tmp_path / "b.mp4").write_bytes(b"x" * 100)
    (tmp_path / "c.mp4").write_bytes(b"x" * 101)
    ids = [r.video_id for r in media.content_ids(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path").collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 16 for i in ids)


def test_models_plug_in(spark):
    media.register("fake", lambda: lambda df: df.assign(score=df.frame * 2.0))
    df = spark.createDataFrame([("v", 1), ("v", 2)], "video string, frame long")
    assert sorted(r.score for r in media.applied(df, "fake", "video string, frame long, score double").collect()) == [2.0, 4.0]
    with pytest.raises(ValueError):
        media.applied(df, "nobody", "x int")

    def broken():
        raise media.ModelUnavailable

    rows, status = media.detections_or_none(spark, broken, "x int")
    assert (rows.count(), status) == (0, "unavailable")


def test_label_files(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"video": "a.mp4", "boundaries": [3.0, 8.0], "annotator": "x"}))
    (folder / "b.json").write_text(json.dumps({"video": "b.mp4", "boundaries": [8.0, 3.0]}))
    (folder / "c.json").write_text("{not json")
    (folder / "splits.json").write_text(json.dumps({"dev": ["a"], "val": [], "test": ["c"]}))
    rows = files.read_labels(spark, str(folder))
    durations = spark.createDataFrame([("a", 20.0), ("b", 20.0)], "stem string, duration double")
    got = {r.stem: r.error for r in files.validated(rows, durations).collect()}
    assert got == {"a": None, "b": "not increasing", "c": "not JSON"}
    roles = files.read_splits(spark, str(folder / "splits.json"))
    assert {r.stem: r.role for r in files.with_roles(rows, roles).collect()} == {"a": "dev", "b": "unassigned", "c": "test"}
    (folder / "splits.json").write_text(json.dumps({"dev": ["a"], "val": ["a"], "test": []}))
    with pytest.raises(ValueError):
        files.read_splits(spark, str(folder / "splits.json"))
    assert sorted(r.time for r in files.boundaries(rows.where("stem = 'a'")).collect()) == [3.0, 8.0]


def test_reviews_and_writers(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"video": "a", "reviews": {"k1": {"verdict": "correct", "type_id": "car", "detection_confidence": 0.5}}}))
    (folder / "b.json").write_text("{broken")
    assert [(r.video, r.key, r.verdict) for r in files.read_reviews(spark, str(folder)).collect()] == [("a", "k1", "correct")]
    df = spark.createDataFrame([("a", "a.mp4", [8.00049, 3.0], "x", "n", "edited")], "stem string, video string, boundaries array<double>, annotator string, notes string, method string")
    docs = files.label_documents(df)
    assert json.loads(docs.first().document)["boundaries"] == [3.0, 8.0]
    files.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    log = spark.createDataFrame([("v", 1)], "video string, seq long")
    for _ in range(2):
        files.append_rows(log, str(tmp_path / "log"))
        files.replace_table(log, str(tmp_path / "table"))
    assert (spark.read.parquet(str(tmp_path / "log")).count(), spark.read.parquet(str(tmp_path / "table")).count()) == (2, 1)
    assert files.report_lines(log, "Log")[-1] == "| v | 1 |"


def test_corrupt_detections_are_set_aside(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"video": "a", "shot": 1, "score": 0.5}\n{oops\n')
    rows = files.read_detections(spark, str(tmp_path)).cache()
    assert rows.where("corrupt IS NULL").count() == 1 and rows.where("corrupt IS NOT NULL").count() == 1


def test_colours(spark):
    import colorsys

    from shotweave.functions import colour

    rng = np.random.default_rng(0)
    rgb = [tuple(map(float, x)) for x in rng.random((50, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rgb, "r double, g double, b double").withColumn("x", colour.hsv(F.col("r"), F.col("g"), F.col("b")))
    for row in df.collect():
        h, s, v = colorsys.rgb_to_hsv(row.r, row.g, row.b)
        assert (row.x.h, row.x.s, row.x.v) == pytest.approx((h * 360, s, v), abs=1e-6)
    cases = {(0.0, 0.0, 0.1): "black", (0.0, 0.0, 0.9): "white", (0.0, 0.1, 0.5): "grey", (350.0, 0.9, 0.9): "red", (30.0, 0.9, 0.4): "brown", (45.0, 0.3, 0.8): "beige", (200.0, 0.5, 0.5): "blue"}
    df = spark.createDataFrame(list(cases), "h double, s double, v double")
    assert {(r.h, r.s, r.v): r.n for r in df.withColumn("n", colour.name(F.col("h"), F.col("s"), F.col("v"))).collect()} == cases
    px = spark.createDataFrame([(1, "red")] * 3 + [(1, "blue")] + [(2, "red"), (2, "blue")], "box long, color string")
    assert {r.box: r.color for r in colour.dominant(px, ["box"]).collect()} == {1: "red", 2: None}


def test_datasets_and_pairs(spark):
    labels_ = spark.createDataFrame([("a", [1.0], None), ("b", [1.0], None), ("c", [9.0], None)], "stem string, boundaries array<double>, error string")
    splits = spark.createDataFrame([("a", "dev"), ("c", "dev")], "stem string, role string")
    videos = spark.createDataFrame([("a", "p/a", 5.0), ("b", "p/b", 5.0), ("c", "p/c", 5.0)], "stem string, path string, duration double")
    assert [r.stem for r in files.dataset(labels_, splits, videos, ["dev", "val"]).collect()] == ["a"]
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair long")
    marks = spark.createDataFrame([(1, "D"), (2, "N"), (3, "U")], "pair long, label string")
    assert {r.pair: r.duplicate for r in diagnose.labelled_pairs(pairs, marks).collect()} == {1: True, 2: False}


def test_moved_and_placeholder_files(spark):
    files = [("/v/a.mp4", 0), ("/up/b.mp4", 0), ("/old/b.mp4", 0), ("/cache/c.mov", media.DATALESS), ("/v/d.mp4", media.DATALESS | 4), ("/else/e.mp4", None), ("/up/f.mp4", None), ("/v/f.mp4", 1)]
    recorded = [("a", "/v/a.mp4"), ("b", "/gone/b.mp4"), ("c", "/gone/c.mov"), ("d", "/v/d.mp4"), ("e", "/gone/e.mp4"), ("f", "/x/f.mp4"), ("f", "/x/f.mp4"), ("n", None)]
    got = media.relocated(spark.createDataFrame(recorded, "video string, path string"), spark.createDataFrame(files, "path string, flags long"), ["/up/", "/v", "/cache"]).collect()
    assert sorted((r.video, r.path, r.status) for r in got if r.video != "n") == [
        ("a", "/v/a.mp4", "here"), ("b", "/up/b.mp4", "moved"), ("c", "/cache/c.mov", "placeholder"), ("d", "/v/d.mp4", "placeholder"),
        ("e", "/gone/e.mp4", "missing"), ("f", "/up/f.mp4", "moved"), ("f", "/up/f.mp4", "moved"),
    ]
    assert [(r.path, r.status) for r in got if r.video == "n"] == [(None, "missing")]


def test_lines_of_a_scene_are_brought_together_once(spark, monkeypatch):
    """By the scene alone and in partitions that grow with the lines, however many types or shots a step tells apart."""
    from shotweave.plans import commerce
    from shotweave.sources import adapters

    monkeypatch.setattr(adapters, "PART_LINES", 1000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    here = "/root/testdata/sf0.001"
    lines = adapters.table(spark, here, "lineitem")
    assert adapters.line_parts(lines) == -(-lines.count() // 1000)
    for query, exchanges in ((commerce.type_groups, 1), (commerce.type_occurrences, 3)):
        text = plan(query(spark, here))
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == exchanges
