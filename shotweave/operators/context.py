"""Where a scene takes place: votes of its shots over prompt vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the scale of logits that prompt vectors are made for.
LOGIT_SCALE = 100.0


#: Prompt vectors that are sent to all tasks at a time; a larger taxonomy takes several passes over the shots.
MOST_PROMPTS = 10_000


def facet_probabilities(shots: DataFrame, prompts: DataFrame, scale: float = LOGIT_SCALE) -> DataFrame:
    """Softmax over contexts by each one's best prompt: video, shot, context, p. ``shots``: video, shot, clip.
    ``prompts``: context, prompt, vec, in slices of MOST_PROMPTS rows; a batch of shots meets a slice in one matrix
    product, and no join is needed."""
    n = prompts.count()
    slices = -(-n // MOST_PROMPTS)
    kinds = {f.name: f.dataType.simpleString() for f in shots.schema}
    schema = f"video {kinds['video']}, shot {kinds['shot']}, context {prompts.schema['context'].dataType.simpleString()}, z double"
    rows = None
    for k in range(slices):
        part = prompts.where(F.pmod(F.xxhash64("context"), F.lit(slices)) == k) if slices > 1 else prompts
        held = part.select("context", "vec").orderBy("context").collect()
        if held:
            one = shots.select("video", "shot", "clip").mapInPandas(_best_logits(held, scale), schema)
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return shots.select("video", "shot", F.lit(None).cast(prompts.schema["context"].dataType).alias("context"), F.lit(0.0).alias("p")).limit(0)
    w = Window.partitionBy("video", "shot")
    e = F.exp(F.col("z") - F.max("z").over(w))
    return rows.withColumn("e", e).select("video", "shot", "context", (F.col("e") / F.sum("e").over(w)).alias("p"))


def _best_logits(prompts: list, scale: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each shot and context, the largest product with one of its prompts. ``prompts`` in order of context."""
    vectors = np.array([p.vec for p in prompts]).T
    names, starts = np.unique([p.context for p in prompts], return_index=True)
    by_name = [prompts[i].context for i in starts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                z = scale * np.maximum.reduceat(np.array(rows["clip"].tolist()) @ vectors, starts, axis=1)
                n = len(names)
                yield pd.DataFrame({"video": rows["video"].repeat(n), "shot": rows["shot"].repeat(n), "context": by_name * len(rows), "z": z.ravel()})

    return run


def venue_votes(probabilities: DataFrame, shots: DataFrame, shown: DataFrame) -> DataFrame:
    """Each shot votes with its duration times its probability on shown contexts, spread over those: video, scene,
    context, vote, evidence. ``shots``: video, scene, shot, start, end. ``shown``: context."""
    rows = probabilities.join(shown, "context").join(shots.select("video", "scene", "shot", F.greatest(F.col("end") - F.col("start"), F.lit(1e-3)).alias("d")), ["video", "shot"])
    w = Window.partitionBy("video", "shot")
    rows = rows.withColumn("informative", F.sum("p").over(w))
    # Weight d * informative times share p / informative is d * p.
    rows = rows.groupBy("video", "scene", "context").agg(F.sum(F.col("d") * F.col("p")).alias("mass"), F.sum("d").alias("seconds"))
    all_ = F.sum("mass").over(Window.partitionBy("video", "scene"))
    return rows.select("video", "scene", "context", (F.col("mass") / F.greatest(all_, F.lit(1e-9))).alias("vote"), (all_ / F.col("seconds")).alias("evidence"))


def ranked(votes: DataFrame, most: int = 3) -> DataFrame:
    order = Window.partitionBy("video", "scene").orderBy(F.desc("vote"), "context")
    return votes.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def gated(votes: DataFrame, min_confidence: float, min_margin: float, min_evidence: float) -> DataFrame:
    """The venue of each scene, or null where evidence, confidence or the lead over the next one is too small."""
    top = ranked(votes, 2).groupBy("video", "scene").agg(F.max_by("context", -F.col("place")).alias("context"), F.max("vote").alias("confidence"), F.min(F.when(F.col("place") == 2, F.col("vote"))).alias("next"), F.max("evidence").alias("evidence"))
    sure = (F.col("evidence") >= min_evidence) & (F.col("confidence") >= min_confidence) & (F.col("confidence") - F.coalesce("next", F.lit(0.0)) >= min_margin)
    return top.select("video", "scene", F.when(sure, F.col("context")).alias("venue"), "confidence", "evidence")


def environments(probabilities: DataFrame, shots: DataFrame, least: float = 0.6) -> DataFrame:
    """The duration-weighted environment of each scene, or null below ``least``."""
    rows = probabilities.join(shots.select("video", "scene", "shot", F.greatest(F.col("end") - F.col("start"), F.lit(1e-3)).alias("d")), ["video", "shot"])
    rows = rows.groupBy("video", "scene", "context").agg((F.sum(F.col("d") * F.col("p")) / F.sum("d")).alias("p"))
    best = rows.groupBy("video", "scene").agg(F.max(F.struct("p", "context")).alias("b"))
    return best.select("video", "scene", F.when(F.col("b.p") >= least, F.col("b.context")).alias("environment"), F.col("b.p").alias("confidence"))
