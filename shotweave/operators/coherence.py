"""How well the shots on both sides of each cut hang together.

``shots``: video, shot (from 0 without gaps), start, end, clip array<double> and color array<double>, one mean vector and
histogram for each shot, both normalised (:func:`mean_features`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..params import Grouping


def mean_features(frames: DataFrame) -> DataFrame:
    """video, shot, clip, color from a row for each frame: each frame normalised, averaged, and normalised again."""
    keys = ["video", "shot"]

    def averaged(column: Column, name: str) -> DataFrame:
        rows = frames.select(*keys, F.posexplode(column).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
        return rows.select(*keys, F.transform("xs", lambda s: s["x"]).alias(name))

    both = averaged(vec.normalized("clip"), "clip").join(averaged(F.col("color"), "color"), keys)
    return both.select(*keys, vec.normalized("clip").alias("clip"), vec.l1_normalized("color").alias("color"))


def band_pairs(shots: DataFrame, reach: int, columns: list[str]) -> DataFrame:
    """Pairs of shots of one video at most ``reach`` apart: video, i, j, and a_ and b_ columns.

    Shots are dealt in blocks of ``reach``; a pair lies in one block or in two neighbouring ones, so this is an equi
    join whose work grows with shots times reach, however long a video is."""
    a = shots.select("video", F.col("shot").alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    a = a.withColumn("block", F.explode(F.array(F.floor(F.col("i") / reach), F.floor(F.col("i") / reach) + 1)))
    b = shots.select(F.col("video").alias("video_b"), F.col("shot").alias("j"), F.floor(F.col("shot") / reach).alias("block_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    near = (F.col("video") == F.col("video_b")) & (F.col("block") == F.col("block_b")) & (F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= reach)
    return a.join(b, near).drop("video_b", "block_b", "block")


def similarity(p: Grouping) -> Column:
    """Of a pair row with a_clip, b_clip, a_color, b_color."""
    clip = vec.rescaled(vec.dot("a_clip", "b_clip"), p.clip_floor)
    return vec.blended(clip, vec.intersection("a_color", "b_color"), p.clip_weight, p.color_weight)


def pair_similarities(shots: DataFrame, p: Grouping, reach: int | None = None) -> DataFrame:
    """video, i, j, similarity, the gap in seconds between them and the start of j, for pairs that any cut's window can hold."""
    pairs = band_pairs(shots, reach or max(1, 2 * p.window_shots - 1), ["clip", "color", "start", "end"])
    return pairs.select("video", "i", "j", similarity(p).alias("similarity"), (F.col("b_start") - F.col("a_end")).alias("gap"), F.col("b_start").alias("start"))


def pair_similarities_in_blocks(shots: DataFrame, p: Grouping, reach: int | None = None) -> DataFrame:
    """The same rows as :func:`pair_similarities`, by one matrix product for each block of ``reach`` shots and the next:
    for long vectors, where array functions element by element cost more than a trip through Arrow (at 512 elements it took a
    third of the time, at 64 twice as long). A group holds at most two blocks, however long a video is."""
    reach = reach or max(1, 2 * p.window_shots - 1)
    own = F.floor(F.col("shot") / reach)
    rows = shots.select("video", "shot", "start", "end", "clip", "color", F.explode(F.array(own, own - 1)).alias("block")).where("block >= 0")

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shot", ignore_index=True)
        shot = rows["shot"].to_numpy()
        n_left = int((shot // reach == key[1]).sum())
        clip, color = np.array(rows["clip"].tolist()), np.array(rows["color"].tolist())
        i, j = np.nonzero((shot[None, :] > shot[:n_left, None]) & (shot[None, :] - shot[:n_left, None] <= reach))
        cosine = (clip[:n_left] @ clip.T)[i, j] if n_left else np.empty(0)
        near = np.clip((cosine - p.clip_floor) / (1 - p.clip_floor), 0, 1)
        similar = (p.clip_weight * near + p.color_weight * np.minimum(color[i], color[j]).sum(axis=1)) / (p.clip_weight + p.color_weight)
        start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
        return pd.DataFrame({"video": key[0], "i": shot[i], "j": shot[j], "similarity": similar, "gap": start[j] - end[i], "start": start[j]})

    kinds = {f.name: f.dataType.simpleString() for f in shots.schema}
    return rows.groupBy("video", "block").applyInPandas(work, f"video {kinds['video']}, i {kinds['shot']}, j {kinds['shot']}, similarity double, gap double, start double")


def cut_links(pairs: DataFrame, p: Grouping) -> DataFrame:
    """Each pair under each cut k (between shots k and k + 1) whose window holds it: video, cut, i, j, value, start (of j)."""
    w = max(1, p.window_shots)
    pairs = pairs.where((F.col("j") - F.col("i") <= 2 * w - 1) & ((F.col("gap") <= p.window_seconds) | (F.col("j") - F.col("i") == 1)))
    cuts = F.sequence(F.greatest(F.col("i"), F.col("j") - w), F.least(F.col("j") - 1, F.col("i") + w - 1))
    value = F.col("similarity") - p.distance_penalty * (F.col("j") - F.col("i") - 1)
    return pairs.select("video", F.explode(cuts).alias("cut"), "i", "j", value.alias("value"), "start")


def coherence(pairs: DataFrame, shots: DataFrame, p: Grouping) -> DataFrame:
    """The mean of each cut's best links: video, cut, time, coherence, score = 1 - coherence, best_i, best_j."""
    n = shots.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    here = Window.partitionBy("video", "cut")
    order = here.orderBy(F.desc("value"), F.desc("i"), F.desc("j"))
    # The shot after the cut is always linked with the one before it, so its start is at hand without another join.
    time = F.max(F.when(F.col("j") == F.col("cut") + 1, F.col("start"))).over(here)
    rows = cut_links(pairs, p).join(n, "video").withColumn("rank", F.row_number().over(order)).withColumn("time", time)
    w = max(1, p.window_shots)
    most = F.greatest(F.lit(1), F.least(F.lit(p.coherence_topk), F.col("cut") + 1, F.col("n") - 1 - F.col("cut"), F.lit(w)))
    best = F.max_by(F.struct("i", "j"), F.struct("value", "i", "j"))
    rows = rows.where(F.col("rank") <= most).groupBy("video", "cut").agg(F.max("time").alias("time"), F.avg("value").alias("coherence"), best.alias("best"))
    return rows.select("video", "cut", "time", "coherence", (1 - F.col("coherence")).alias("score"), F.col("best.i").alias("best_i"), F.col("best.j").alias("best_j"))


def depth_window(scores: DataFrame, radius: int) -> DataFrame:
    """Adds ``depth``: how far a score stands above the least of ``radius`` cuts on each side, each side at least 0."""
    w = Window.partitionBy("video").orderBy("cut")
    side = lambda frame: F.coalesce(F.greatest(F.lit(0.0), F.col("score") - F.min("score").over(frame)), F.lit(0.0))
    return scores.withColumn("depth", side(w.rowsBetween(-radius, -1)) + side(w.rowsBetween(1, radius)))


def depth_climb(scores: DataFrame) -> DataFrame:
    """Adds ``depth``: the way down to the foot of the slope on each side. A slope is a run in which no score falls
    (from the left) or rises (to the right), so its foot is the run's first or last score."""
    w = Window.partitionBy("video").orderBy("cut")
    back = Window.partitionBy("video").orderBy(F.desc("cut"))
    falls = F.coalesce((F.lag("score").over(w) > F.col("score")).cast("int"), F.lit(0))
    rises = F.coalesce((F.lead("score").over(w) > F.col("score")).cast("int"), F.lit(0))
    rows = scores.withColumn("_falls", falls).withColumn("_rises", rises)
    rows = rows.withColumn("_up", F.sum("_falls").over(w)).withColumn("_down", F.sum("_rises").over(back))
    left = F.first("score").over(Window.partitionBy("video", "_up").orderBy("cut"))
    right = F.first("score").over(Window.partitionBy("video", "_down").orderBy(F.desc("cut")))
    depth = (F.col("score") - left) + (F.col("score") - right)
    return rows.withColumn("depth", depth).drop("_falls", "_rises", "_up", "_down")


def depths(scores: DataFrame, p: Grouping) -> DataFrame:
    return depth_climb(scores) if p.depth_mode == "climb" else depth_window(scores, max(1, p.window_shots // 2))


def first_decision(p: Grouping) -> Column:
    """below_abs, below_depth, or '' for a cut that may become a boundary."""
    decision = F.when(F.col("score") < p.abs_threshold, "below_abs").when(F.col("score") >= p.strong_threshold, "")
    return decision.when(F.col("depth") < p.depth_threshold, "below_depth").otherwise("")


#: What scores and depths hang on; the rest of the parameters are thresholds.
SCORED = ("clip_weight", "color_weight", "clip_floor", "window_shots", "window_seconds", "distance_penalty", "coherence_topk", "depth_mode")


#: Of these, what a pair's value and its cuts hang on; settings that differ in the rest share ranked links.
LINKED = ("clip_weight", "color_weight", "clip_floor", "window_shots", "window_seconds", "distance_penalty")
#: Cuts of one video that a task takes together.
PART_CUTS = 1000


def grid_scores(shots: DataFrame, settings: list[Grouping]) -> DataFrame:
    """Scores and depths of all cuts under many settings in one plan: scored (the setting's number), video, cut, time, score, depth.

    Pairs of the widest window are made once and brought together by stretches of cuts; there, in place, settings are rows that meet them, and a narrower
    window takes those of its own reach. Links are ranked once for all settings that share them, whatever number of the best each takes."""
    reach = max(1, *(2 * p.window_shots - 1 for p in settings))
    widest = max(1, *(p.window_shots for p in settings))
    shots = shots.join(shots.groupBy("video").agg(F.count(F.lit(1)).alias("n")), "video")
    pairs = band_pairs(shots, reach, ["clip", "color", "start", "end", "n"])
    pairs = pairs.select("video", "i", "j", vec.dot("a_clip", "b_clip").alias("cosine"), vec.intersection("a_color", "b_color").alias("shared"), (F.col("b_start") - F.col("a_end")).alias("gap"), F.col("b_start").alias("start"), F.col("a_n").alias("n"))
    part = lambda cut: F.floor(cut / PART_CUTS)
    first, last = (lambda w: F.greatest(F.col("i"), F.col("j") - w)), (lambda w: F.least(F.col("j") - 1, F.col("i") + w - 1))
    parts = int(shots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("part", F.explode(F.sequence(part(first(widest)), part(last(widest))))).repartition(parts, "video", "part")
    alike: dict[tuple, list[int]] = {}
    for n, p in enumerate(settings):
        alike.setdefault(tuple(getattr(p, c) for c in LINKED), []).append(n)
    rules = []
    for link, numbers in enumerate(alike.values()):
        p, tops = settings[numbers[0]], [F.struct(F.lit(n).alias("scored"), F.lit(settings[n].coherence_topk).alias("top")) for n in numbers]
        most = F.lit(max(settings[n].coherence_topk for n in numbers)).alias("most")
        rules.append(F.struct(F.lit(link).alias("link"), *[F.lit(float(getattr(p, c))).alias(c) for c in LINKED], F.lit(max(1, p.window_shots)).alias("w"), most, F.array(*tops).alias("tops")))
    rows = pairs.select("*", F.inline(F.array(*rules)))
    apart = F.col("j") - F.col("i")
    rows = rows.where((apart <= 2 * F.col("w") - 1) & ((F.col("gap") <= F.col("window_seconds")) | (apart == 1)))
    weights = F.col("clip_weight"), F.col("color_weight")
    similar = (vec.rescaled(F.col("cosine"), F.col("clip_floor")) * weights[0] + F.col("shared") * weights[1]) / (weights[0] + weights[1])
    value = (similar - F.col("distance_penalty") * (apart - 1)).alias("value")
    rows = rows.select("link", "video", "part", "n", "w", "most", "tops", "i", "j", "start", value, F.explode(F.sequence(first(F.col("w")), last(F.col("w")))).alias("cut")).where(part(F.col("cut")) == F.col("part"))
    here = Window.partitionBy("link", "video", "part", "cut")
    time = F.max(F.when(F.col("j") == F.col("cut") + 1, F.col("start"))).over(here)
    rows = rows.withColumn("rank", F.row_number().over(here.orderBy(F.desc("value"), F.desc("i"), F.desc("j")))).withColumn("time", time)
    best = lambda top: F.greatest(F.lit(1), F.least(top, F.col("cut") + 1, F.col("n") - 1 - F.col("cut"), F.col("w")))
    rows = rows.where(F.col("rank") <= best(F.col("most"))).select("*", F.inline("tops")).where(F.col("rank") <= best(F.col("top")))
    rows = rows.groupBy("link", "video", "part", "cut", "scored").agg(F.max("time").alias("time"), (1 - F.avg("value")).alias("score"))
    own = rows.select(F.struct("scored", "video").alias("video"), "cut", "time", "score")  # each setting's cuts are a video of their own
    if any(p.depth_mode == "climb" for p in settings):
        own = depth_climb(own).withColumnRenamed("depth", "depth_climb")
    for r in sorted({max(1, p.window_shots // 2) for p in settings if p.depth_mode != "climb"}):
        own = depth_window(own, r).withColumnRenamed("depth", f"depth_{r}")
    named = [f"depth_{p.depth_mode if p.depth_mode == 'climb' else max(1, p.window_shots // 2)}" for p in settings]
    chosen = F.coalesce(*[F.when(F.col("video.scored").isin([n for n, x in enumerate(named) if x == name]), F.col(name)) for name in sorted(set(named))])
    return own.select("video.*", "cut", "time", "score", chosen.alias("depth"))
