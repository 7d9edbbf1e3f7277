"""Frames to cuts, cuts to shots, and shots against segments. Every table has a ``video`` key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import exact_unions


def islands(frames: DataFrame, above: Column) -> DataFrame:
    """Runs of consecutive frames for which ``above`` holds: video, first, last, peak. ``frames``: video, frame, prob."""
    w = Window.partitionBy("video").orderBy("frame")
    rows = frames.where(above).withColumn("island", F.col("frame") - F.row_number().over(w))
    return rows.groupBy("video", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.max("prob").alias("peak")).drop("island")


def cuts(frames: DataFrame, threshold: float) -> DataFrame:
    """A cut in the middle of each run above the threshold, inside the video: video, cut, peak."""
    n = frames.groupBy("video").agg((F.max("frame") + 1).alias("n_frames"))
    runs = islands(frames, F.col("prob") > threshold)
    runs = runs.withColumn("cut", F.floor((F.col("first") + F.col("last") + 2) / 2))
    return runs.join(n, "video").where("cut > 0 AND cut < n_frames").select("video", "cut", "peak", "n_frames")


def interior(cuts: DataFrame) -> DataFrame:
    """Distinct cuts strictly inside their video: video, cut, n_frames."""
    return cuts.where("cut > 0 AND cut < n_frames").select("video", "cut", "n_frames").distinct()


def min_frames(min_seconds: float, fps: float) -> int:
    return max(1, round(min_seconds * fps))


def merge_short(cuts: DataFrame, least: int) -> DataFrame:
    """Drop cuts that would make a shot of fewer than ``least`` frames, each measured from the last cut that is kept;
    then drop kept cuts from the end while the last shot is too short. A fold over one video's cuts."""
    inside = interior(cuts)
    if least <= 1:
        return inside.select("video", "cut")
    start = F.array().cast("array<bigint>")
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0).cast("long"))
    keep = F.aggregate("all", start, lambda kept, c: F.when(c - last(kept) >= least, F.concat(kept, F.array(c))).otherwise(kept))
    rows = inside.groupBy("video", "n_frames").agg(F.array_sort(F.collect_list("cut")).alias("all")).withColumn("kept", keep)
    # Kept cuts ascend, so those too near the end are a tail; all others stay.
    return rows.select("video", F.explode(F.filter("kept", lambda c: F.col("n_frames") - c >= least)).alias("cut"))


def segments(edges: DataFrame, at: str, ends: DataFrame, end: str, start: float | int = 0) -> DataFrame:
    """Edges inside (start, end) to numbered segments that cover the video: video, segment (from 0), begin, finish.
    ``ends`` has a row for each video, also for those without edges."""
    inside = edges.join(ends, "video").where((F.col(at) > start) & (F.col(at) < F.col(end))).select("video", F.col(at).alias("begin"))
    kind = inside.schema["begin"].dataType
    exact_unions(ends.sparkSession)
    rows = inside.unionByName(ends.select("video", F.lit(start).cast(kind).alias("begin"))).distinct()
    w = Window.partitionBy("video").orderBy("begin")
    rows = rows.select("video", (F.row_number().over(w) - 1).cast("long").alias("segment"), "begin", F.lead("begin").over(w).alias("next"))
    return rows.join(ends.select("video", end), "video").select("video", "segment", "begin", F.coalesce("next", end).alias("finish"))


def shots_from_cuts(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """Shots with frames and seconds. ``videos``: video, n_frames, fps, duration; the last shot ends with the video."""
    parts = segments(cuts, "cut", videos.select("video", "n_frames"), "n_frames").join(videos, "video")
    ends = F.when(F.col("finish") == F.col("n_frames"), F.col("duration")).otherwise(F.col("finish") / F.col("fps"))
    return parts.select("video", F.col("segment").alias("shot"), F.col("begin").alias("start_frame"), F.col("finish").alias("end_frame"), F.bround(F.col("begin") / F.col("fps"), 3).alias("start"), F.bround(ends, 3).alias("end"))


def sampled_frames(shots: DataFrame, positions: tuple[float, ...]) -> DataFrame:
    """Frames to look at in each shot, at relative positions: video, shot, pos, frame."""
    length = F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame"))
    at = F.posexplode(F.array(*map(F.lit, positions))).alias("pos", "p")
    rows = shots.select("video", "shot", "start_frame", "end_frame", length.alias("length"), at)
    frame = F.least(F.col("start_frame") + F.floor(F.col("p") * F.col("length")), F.col("end_frame") - 1)
    return rows.select("video", "shot", F.col("pos").cast("long").alias("pos"), frame.cast("long").alias("frame"))


def containment(shots: DataFrame, scenes: DataFrame, slack: float = 1e-3) -> DataFrame:
    """The segment each shot starts in: video, shot, segment. ``scenes`` (segments) cover the video, so the segment is
    how many of them have begun."""
    exact_unions(shots.sparkSession)
    edges = scenes.select("video", (F.col("begin") - slack).alias("at"), F.lit(1).alias("opens"), F.lit(None).cast("long").alias("shot"))
    rows = edges.unionByName(shots.select("video", F.col("start").alias("at"), F.lit(0).alias("opens"), F.col("shot").cast("long").alias("shot")))
    w = Window.partitionBy("video").orderBy("at", F.col("opens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum("opens").over(w) - 1).where("opens = 0").select("video", "shot", F.col("segment").cast("long").alias("segment"))


def nearest(left: DataFrame, at: str, right: DataFrame, to: str, before: float, after: float) -> DataFrame:
    """For each row of ``left`` the nearest of ``right`` in [at - before, at + after], the earlier on ties; null if none.

    Both are dealt in cells as wide as the reach, and each row of ``left`` meets two or three cells of ``right``: an equi
    join with a range check, not a comparison with all of a video's rows."""
    cell = float(max(before + after, 1e-6))
    lo, hi = F.floor((F.col(at) - before) / cell), F.floor((F.col(at) + after) / cell)
    a = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", F.explode(F.sequence(lo, hi)))
    b = right.select(F.col("video").alias("_video"), F.col(to).alias("_to"), F.floor(F.col(to) / cell).alias("_key"))
    near = (a["video"] == b["_video"]) & (a["_cell"] == b["_key"]) & (F.col("_to") >= F.col(at) - before) & (F.col("_to") <= F.col(at) + after)
    best = F.min(F.when(F.col("_to").isNotNull(), F.struct(F.abs(F.col("_to") - F.col(at)).alias("d"), F.col("_to").alias("to")))).alias("_best")
    rows = a.join(b, near, "left").groupBy("_row", *left.columns).agg(best)
    return rows.select(*left.columns, F.col("_best.to").alias("nearest"))


def filled(features: DataFrame, value: str) -> DataFrame:
    """Missing values from the shot before; a missing first one from the second only. ``features``: video, shot, value."""
    w = Window.partitionBy("video").orderBy("shot")
    second = F.when(F.col("shot") == 0, F.lead(value).over(w))
    known = features.withColumn(value, F.coalesce(value, second))
    return known.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def adaptive_cuts(frames: DataFrame, ratio: float = 3.0, least: float = 15.0, reach: int = 2) -> DataFrame:
    """Cuts where a frame's change stands out from its neighbours' mean by ``ratio`` and is at least ``least``: video,
    cut, peak, n_frames. The first and last ``reach`` frames can't be judged. ``frames``: video, frame, prob."""
    w = Window.partitionBy("video").orderBy("frame")
    around = (F.sum("prob").over(w.rowsBetween(-reach, reach)) - F.col("prob")) / (2 * reach)
    rows = frames.withColumn("n_frames", F.count(F.lit(1)).over(Window.partitionBy("video"))).withColumn("around", around)
    stands = F.when(F.col("around") > 1e-5, F.col("prob") / F.col("around")).otherwise(F.when(F.col("prob") >= least, 255.0).otherwise(0.0))
    inside = (F.col("frame") >= reach) & (F.col("frame") < F.col("n_frames") - reach)
    return rows.where(inside & (stands >= ratio) & (F.col("prob") >= least)).select("video", F.col("frame").alias("cut"), F.col("prob").alias("peak"), "n_frames")


#: Ways from a frame signal to cuts, by name; each takes frames and a threshold.
DETECTORS = {"threshold": cuts, "adaptive": adaptive_cuts}


def detected_shots(frames: DataFrame, videos: DataFrame, detector: str, threshold: float, least: int) -> DataFrame:
    """Frames to shots by a named detector; an unknown name is an error."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown shot detector: {detector}")
    return shots_from_cuts(merge_short(DETECTORS[detector](frames, threshold), least), videos)


def frame_time(start: Column, end: Column, position: Column, fps: Column) -> Column:
    """A moment inside a shot at a relative position, a frame or a quarter of the shot from its ends."""
    margin = F.least(1.0 / F.greatest(fps, F.lit(1.0)), (end - start) / 4)
    return F.least(F.greatest(start + position * (end - start), start + margin), end - margin)
