"""Scene segmentation: the whole way from shots with features to numbered scenes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Grouping
from ..sources.tables import materialised
from . import coherence, suppress, timeline


def durations(shots: DataFrame) -> DataFrame:
    return shots.groupBy("video").agg(F.max("end").alias("duration"))


def cut_decisions(shots: DataFrame, p: Grouping, pairs: DataFrame | None = None) -> DataFrame:
    """Every cut with score, depth and decision. ``pairs`` may be given where several settings share them."""
    pairs = coherence.pair_similarities(shots, p) if pairs is None else pairs
    cuts = coherence.depths(coherence.coherence(pairs, shots, p), p).join(durations(shots), "video")
    return suppress.decided(cuts, coherence.first_decision(p), F.col("score"), p.min_scene_seconds)


def scenes(boundaries: DataFrame, shots: DataFrame) -> DataFrame:
    """Numbered scenes between boundaries (video, time), with the shots that start in them: video, scene_id (from 1),
    start_seconds, end_seconds, duration_seconds, shot_start, shot_end (null for none), shot_count, mid_shot."""
    parts = timeline.segments(boundaries.select("video", F.col("time").cast("double").alias("time")), "time", durations(shots), "duration", 0.0)
    held = timeline.containment(shots, parts).groupBy("video", "segment").agg(F.min("shot").alias("shot_start"), F.max("shot").alias("shot_end"), F.count(F.lit(1)).alias("shot_count"))
    rows = parts.join(held, ["video", "segment"], "left")
    return rows.select(
        "video", (F.col("segment") + 1).alias("scene_id"), F.bround("begin", 3).alias("start_seconds"), F.bround("finish", 3).alias("end_seconds"),
        F.bround(F.col("finish") - F.col("begin"), 3).alias("duration_seconds"), "shot_start", "shot_end", F.coalesce("shot_count", F.lit(0).cast("long")).alias("shot_count"),
        F.floor((F.col("shot_start") + F.col("shot_end")) / 2).alias("mid_shot"),
    )


def segmented(shots: DataFrame, p: Grouping) -> DataFrame:
    boundaries = cut_decisions(shots, p).where("decision = 'boundary'").select("video", F.bround("time", 3).alias("time"))
    return scenes(materialised(boundaries, "boundaries"), shots)


def every_cut(shots: DataFrame) -> DataFrame:
    """Baseline: every cut is a boundary."""
    return scenes(shots.where("shot > 0").select("video", F.col("start").alias("time")), shots)


def adjacent_only(p: Grouping) -> Grouping:
    """Baseline: settings under which a cut is judged by its two neighbours alone."""
    return dataclasses.replace(p, window_shots=1, coherence_topk=1)


def public_json(scenes: DataFrame) -> DataFrame:
    """One JSON document for each video, as it is handed out: video, document."""
    scene = F.struct("scene_id", "start_seconds", "end_seconds", "duration_seconds")
    rows = scenes.groupBy("video").agg(F.sort_array(F.collect_list(scene)).alias("scenes"), F.max("end_seconds").alias("duration_seconds"), F.count(F.lit(1)).alias("scene_count"))
    return rows.select("video", F.to_json(F.struct("video", "duration_seconds", "scene_count", "scenes")).alias("document"))


def clip_plan(scenes: DataFrame) -> DataFrame:
    """What an exporter would cut: video, scene_id, start, duration, file."""
    return scenes.select("video", "scene_id", F.col("start_seconds").alias("start"), F.col("duration_seconds").alias("duration"), F.format_string("scene_%03d.mp4", "scene_id").alias("file"))


def full_result(scenes: DataFrame, cuts: DataFrame, shots: DataFrame) -> DataFrame:
    """One JSON document for each video with what its scenes were decided by: video, document."""
    scene = F.struct("scene_id", "start_seconds", "end_seconds", "duration_seconds", "shot_start", "shot_end", "shot_count")
    cut = F.struct("cut", "time", F.bround("score", 4).alias("score"), F.bround("depth", 4).alias("depth"), "decision")
    rows = scenes.groupBy("video").agg(F.sort_array(F.collect_list(scene)).alias("scenes"))
    rows = rows.join(cuts.groupBy("video").agg(F.sort_array(F.collect_list(cut)).alias("cuts")), "video", "left")
    rows = rows.join(shots.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("shot", "start", "end"))).alias("shots")), "video", "left")
    return rows.select("video", F.to_json(F.struct("video", "scenes", F.struct("cuts", "shots").alias("debug"))).alias("document"))


def overlaid(predicted: DataFrame, corrected: DataFrame) -> DataFrame:
    """Boundaries that hold: a person's where there are any for the video, else the predicted ones: video, time."""
    kept = predicted.join(corrected.select("video").distinct(), "video", "left_anti")
    return kept.select("video", "time").unionByName(corrected.where("time IS NOT NULL").select("video", "time"))
