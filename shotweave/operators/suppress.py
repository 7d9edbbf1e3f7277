"""Greedy choice in time: the strongest first, each at least so far from all that are chosen and from both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice(queue: str, duration: Column, least: float | Column) -> Column:
    """The chosen times of a queue of structs with a time, in order, each choice depending on those before it."""
    ends = F.array(F.lit(0.0), duration.cast("double"))
    free = lambda taken, t: F.forall(taken, lambda x: F.abs(x - t) >= least)
    taken = F.aggregate(queue, ends, lambda taken, c: F.when(free(taken, c["time"]), F.concat(taken, F.array(c["time"]))).otherwise(taken))
    return F.slice(taken, 3, F.size(queue) + 1)


def chosen_times(candidates: DataFrame, strength: Column, least: float | str) -> DataFrame:
    """video, chosen array<double> in order of choice. ``candidates``: video, time, duration; equal strengths in order of
    time. ``least`` may name a column that a video's candidates share. A fold over one video's candidates; filter them first."""
    entry = F.struct((-strength).alias("key"), F.col("time"))
    named = isinstance(least, str)
    rows = candidates.groupBy("video", "duration", *[least] * named).agg(F.array_sort(F.collect_list(entry)).alias("queue"))
    return rows.select("video", choice("queue", F.col("duration"), F.col(least) if named else least).alias("chosen"))


def decided(cuts: DataFrame, decision: Column, strength: Column, least: float) -> DataFrame:
    """``cuts`` (video, cut, time, duration) with a final decision: what ``decision`` says, or for its '' boundary or
    min_duration. A video's cuts are gathered once, folded and dealt out again, so they aren't worked out twice."""
    own = [F.col(c) for c in cuts.columns if c not in ("video", "duration")]
    waiting = F.when(F.col("decision") == "", F.struct((-strength).alias("key"), F.col("time")))
    rows = cuts.withColumn("decision", decision).groupBy("video", "duration")
    rows = rows.agg(F.collect_list(F.struct(*own, "decision")).alias("all"), F.array_sort(F.collect_list(waiting)).alias("queue"))
    rows = rows.select("video", "duration", choice("queue", F.col("duration"), least).alias("chosen"), F.explode("all").alias("c")).select("video", "duration", "chosen", "c.*")
    final = F.when(F.col("decision") != "", F.col("decision")).when(F.array_contains("chosen", F.col("time")), "boundary").otherwise("min_duration")
    return rows.withColumn("decision", final).drop("chosen")
