"""Nested documents of scenes against plain dictionaries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shotweave.operators import boxes


def test_documents_hold_what_the_flat_rows_tell(spark):
    rng = random.Random(11)
    dets = []
    for scene in range(12):
        for n in range(rng.randrange(40)):
            x, y = rng.random() * 0.6, rng.random() * 0.6
            dets.append((scene, n, rng.choice(["tv", "sofa", "lamp"]), "g", round(rng.random(), 5), x, y, x + rng.random() * 0.4, y + rng.random() * 0.4, rng.randrange(4), 0.9))
    detections = spark.createDataFrame(dets, "scene long, det long, type_id string, grp string, score double, x1 double, y1 double, x2 double, y2 double, shot long, base double")
    tiers = spark.createDataFrame([("tv", 0.5), ("sofa", None)], "type_id string, tier double")
    occ = [(s, u, u + 4 * k, float(u + 4 * k), float(u + 4 * k) + 2) for s in range(12) for u in range(4) for k in range(3)]
    occurrences = spark.createDataFrame(occ, "scene long, unit long, shot long, start double, end double")
    credit = boxes.credited(detections.select("scene", F.col("shot").alias("unit"), F.col("shot").alias("rep_shot"), "type_id"), occurrences)
    rows = boxes.candidates(detections, tiers, 0.4, 0.3).withColumns({"key": F.lit("k"), "color": F.lit("red"), "label": F.col("type_id"), "category": F.upper("type_id")})
    scenes = spark.createDataFrame([(s, 4) for s in range(14)], "scene long, unique_shots long")
    contexts = spark.createDataFrame([(0, "bar", "FOOD", 0.8, "indoors"), (13, "sea", None, 0.7, None)], "scene long, venue string, venue_category string, venue_confidence double, environment string")
    docs = {r.scene: r for r in boxes.documents(rows, credit, detections, scenes, contexts, 0.4).collect()}
    flat = {(r.scene, r.type_id): r for r in boxes.assembled(rows, credit).collect()}
    own = {(r.scene, r.type_id): r for r in rows.collect()}
    assert set(docs) == set(range(14)) and docs[13].candidates == [] and docs[13].unique_shots_analysed == 0
    assert docs[13].context.venue == "sea" and docs[13].categories_present == []
    assert sum(len(d.candidates) for d in docs.values()) == len(flat)
    for scene, doc in docs.items():
        mine = [d for d in dets if d[0] == scene]
        assert doc.unique_shots_analysed == len({d[9] for d in mine})
        order = sorted((c for c in doc.candidates), key=lambda c: (not c.displayed, -round(c.relevance * round(own[scene, c.type_id].score, 4), 9), c.type_id))
        assert [c.type_id for c in doc.candidates] == [c.type_id for c in order] and [c.place for c in order] == list(range(1, len(order) + 1))
        assert doc.categories_present == sorted({c.category for c in doc.candidates if c.displayed} | ({"FOOD"} if scene == 0 else set()))
        for c in doc.candidates:
            said = flat[scene, c.type_id]
            assert all(c[k] == said[k] for k in said.asDict() if k != "scene")
            raw = sorted((d for d in mine if d[2] == c.type_id), key=lambda d: (-d[4], d[1]))
            assert [d.det for d in c.debug.detections] == [d[1] for d in raw[:12]] and c.debug.unique_shot_ids == sorted({d[9] for d in raw})
            assert c.debug.threshold == max(0.4, 0.5 if c.type_id == "tv" else 0.0) and (c.color == "red") == c.displayed
            assert [o.start for o in c.occurrences] == sorted(o.start for o in c.occurrences) and len(c.occurrences) == c.seen_count
            assert (c.best.det, c.best.shot) == (raw[0][1], raw[0][9])


def test_no_detections(spark):
    none = spark.createDataFrame([], "scene long, det long, type_id string, grp string, score double, x1 double, y1 double, x2 double, y2 double, shot long, base double")
    tiers = spark.createDataFrame([], "type_id string, tier double")
    rows = boxes.candidates(none, tiers, 0.4, 0.3).withColumns({"key": F.lit("k"), "color": F.lit("red"), "label": F.col("type_id"), "category": F.lit("c")})
    occurrences = spark.createDataFrame([], "scene long, unit long, shot long, start double, end double")
    credit = boxes.credited(none.select("scene", F.col("shot").alias("unit"), F.col("shot").alias("rep_shot"), "type_id"), occurrences)
    scenes = spark.createDataFrame([(1, 2)], "scene long, unique_shots long")
    contexts = spark.createDataFrame([], "scene long, venue string, venue_category string, venue_confidence double, environment string")
    doc = boxes.documents(rows, credit, none, scenes, contexts, 0.4).collect()
    assert [(d.scene, d.candidates, d.unique_shots_analysed) for d in doc] == [(1, [], 0)]
