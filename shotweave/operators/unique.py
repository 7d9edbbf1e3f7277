"""Repeated shots inside a scene: probability of being the same set-up, clusters, representatives.

``shots``: video, scene, shot, start, end, clip array<double> (normalised; one frame) or frames array<array<double>>,
color, phash long, has_thumb, sharpness, brightness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..params import Unique
from ..sources.tables import exact_unions, materialised

KEYS = ["video", "scene"]


def probability(clip: Column, color: Column, phash: Column, p: Unique) -> Column:
    return vec.sigmoid(clip * p.w_clip + color * p.w_color + phash * p.w_phash + p.bias)


def scene_pairs(shots: DataFrame, p: Unique) -> DataFrame:
    """Every two shots of a scene: video, scene, i, j, clip, color, phash, prob. Where a thumbnail is missing the hash
    says nothing."""
    many = "frames" in shots.columns
    columns = ["frames" if many else "clip", "color", "phash", "has_thumb"]
    a = shots.select(*KEYS, F.col("shot").alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = shots.select(*KEYS, F.col("shot").alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    pairs = a.join(b, KEYS).where("i < j")
    clip = vec.matched(vec.frame_similarities("a_frames", "b_frames")) if many else vec.dot("a_clip", "b_clip")
    phash = F.when(F.col("a_has_thumb") & F.col("b_has_thumb"), vec.bit_agreement("a_phash", "b_phash")).otherwise(p.phash_neutral)
    pairs = pairs.select(*KEYS, "i", "j", clip.alias("clip"), vec.intersection("a_color", "b_color").alias("color"), phash.alias("phash"))
    return pairs.withColumn("prob", probability(F.col("clip"), F.col("color"), F.col("phash"), p))


def state(prob: Column, p: Unique) -> Column:
    return F.when(prob >= p.duplicate_threshold, "duplicate").when(prob >= p.different_threshold, "uncertain").otherwise("different")


#: Averages of distances are told apart by so many digits.
DIGITS = 12


def linked_clusters(prob: np.ndarray, threshold: float, linkage: str) -> np.ndarray:
    """Labels by first appearance. The two nearest clusters merge while their distance (1 - prob, average, single or
    complete) is at most 1 - threshold; equal distances in order of place.

    Each cluster knows its nearest later one, so a merge looks at the rows that it changes, not at all of them."""
    n = len(prob)
    dist = 1.0 - prob
    np.fill_diagonal(dist, np.inf)
    total, size, owner = dist.copy(), np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    nearest, least = np.zeros(n, int), np.full(n, np.inf)

    def look(i: int) -> None:
        if i + 1 < n:
            nearest[i] = i + 1 + int(np.argmin(dist[i, i + 1 :]))
            least[i] = dist[i, nearest[i]]

    dist = np.round(dist, DIGITS)
    for i in range(n):
        look(i)
    for _ in range(n - 1):
        a = int(np.argmin(least))
        b = int(nearest[a])
        if not least[a] <= 1.0 - threshold + 1e-12:
            break
        alive[b], owner[owner == b] = False, a
        if linkage == "average":
            total[a] += total[b]
            total[:, a] = total[a]
            size[a] += size[b]
            joined = np.round(total[a] / (size[a] * size), DIGITS)
        else:
            joined = np.minimum(dist[a], dist[b]) if linkage == "single" else np.maximum(dist[a], dist[b])
        joined[~alive], joined[a] = np.inf, np.inf
        dist[a], dist[:, a] = joined, joined
        dist[b], dist[:, b], least[b] = np.inf, np.inf, np.inf
        look(a)
        for i in np.flatnonzero(alive[:b] & ((nearest[:b] == b) | (nearest[:b] == a))):  # what lies nearest to them may have changed
            if i != a:
                look(i)
        closer = np.flatnonzero(alive[:a] & ((dist[:a, a] < least[:a]) | ((dist[:a, a] == least[:a]) & (a < nearest[:a]))))
        nearest[closer], least[closer] = a, dist[closer, a]
    _, first, label = np.unique(owner, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def _roots(edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The first shot that each shot is connected to: video, scene, shot, root of shots with an edge (video, scene, i, j). A scene's edges
    pass by in batches; what is kept of them is a root for each shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene: tuple | None = None
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def told() -> Iterator[pa.RecordBatch]:
            if scene is not None:
                shots = sorted(root)
                arrays = [pa.array([scene[0]] * len(shots), types[0]), pa.array([scene[1]] * len(shots), types[1]), pa.array(shots, types[2]), pa.array([find(s) for s in shots], types[2])]
                yield pa.RecordBatch.from_arrays(arrays, ["video", "scene", "shot", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in ("video", "scene", "i")]
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            i, j = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            starts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a] != scene:
                    yield from told()
                    scene, root = keys[a], {}
                for x, y in zip(i[a:b].tolist(), j[a:b].tolist()):
                    root.setdefault(x, x), root.setdefault(y, y)
                    x, y = find(x), find(y)
                    root[max(x, y)] = min(x, y)
        if scene is not None:
            yield from told()

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select(*KEYS, "i", "j").repartition(n, *KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, f"video {kinds['video']}, scene {kinds['scene']}, shot {kinds['shot']}, root {kinds['shot']}")


def clusters(shots: DataFrame, pairs: DataFrame, p: Unique) -> DataFrame:
    """A group number (from 0, by first appearance) for each shot: video, scene, shot, grp.

    Clusters merge only where some two of their shots reach the threshold, so each lies within a component of such edges; single linkage
    gives the components. For other linkages, the pairs of each component of three shots or more are one group of rows, which is merged step by step:
    a scene may have very many shots, and a group has those of one component."""
    exact_unions(pairs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in shots.schema}
    edges = pairs.where(1 - F.col("prob") <= 1 - p.duplicate_threshold + 1e-12)
    roots = _roots(edges, kinds)
    if p.linkage == "single":
        grouped = roots.select(*KEYS, "shot", F.col("root").alias("first"))
    else:
        roots = materialised(roots, "roots")
        sizes = roots.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "root")) > 2)
        large = sizes.where("many").select(*KEYS, "shot", "root")
        own = large.select(*KEYS, F.col("shot").alias("i"), "root"), large.select(*KEYS, F.col("shot").alias("j"), F.col("root").alias("other"))
        within = pairs.select(*KEYS, "i", "j", "prob").join(own[0], [*KEYS, "i"]).join(own[1], [*KEYS, "j"]).where("root = other")

        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(np.concatenate([rows.i, rows.j]))
            prob = np.zeros((len(ids), len(ids)))
            i, j = np.searchsorted(ids, rows.i), np.searchsorted(ids, rows.j)
            prob[i, j] = prob[j, i] = rows.prob
            label = linked_clusters(prob, p.duplicate_threshold, p.linkage)
            return pd.DataFrame({"video": key[0], "scene": key[1], "shot": ids, "first": ids[np.unique(label, return_index=True)[1]][label]})

        schema = f"video {kinds['video']}, scene {kinds['scene']}, shot {kinds['shot']}, first {kinds['shot']}"
        merged = within.groupBy(*KEYS, "root").applyInPandas(work, schema)
        grouped = merged.unionByName(sizes.where("NOT many").select(*KEYS, "shot", F.col("root").alias("first")))
    every = shots.select(*KEYS, "shot").join(grouped, [*KEYS, "shot"], "left").withColumn("first", F.coalesce("first", "shot"))
    return every.select(*KEYS, "shot", (F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("first")) - 1).cast("long").alias("grp"))


def rank01(value: str, group: list[str]) -> Column:
    """Average ranks scaled to [0, 1]; 1 for a single row."""
    w = Window.partitionBy(*group)
    n, ties = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    rank = F.rank().over(w.orderBy(value)) + (ties - 1) / 2
    return F.when(n == 1, 1.0).otherwise((rank - 1) / (n - 1))


def scored_members(shots: DataFrame, pairs: DataFrame, groups: DataFrame, p: Unique) -> DataFrame:
    """Adds to ``groups`` what a representative is chosen by, and its score: centrality (mean probability to the other
    members), sharpness, duration, stability (of the shot's frames), exposure, score."""
    both = pairs.select(*KEYS, F.col("i").alias("shot"), F.col("j").alias("other"), "prob").unionByName(pairs.select(*KEYS, F.col("j").alias("shot"), F.col("i").alias("other"), "prob"))
    other = groups.select(*KEYS, F.col("shot").alias("other"), F.col("grp").alias("other_grp"))
    central = both.join(groups, [*KEYS, "shot"]).join(other, [*KEYS, "other"]).where("grp = other_grp").groupBy(*KEYS, "shot").agg(F.avg("prob").alias("centrality"))
    stable = vec.stability("frames") if "frames" in shots.columns else F.lit(1.0)
    own = shots.select(*KEYS, "shot", "start", "end", F.log1p("sharpness").alias("sharpness"), F.log1p(F.col("end") - F.col("start")).alias("log_duration"), stable.alias("stability"), (1 - F.abs(F.col("brightness") - 0.45) / 0.55).alias("exposure"))
    rows = groups.join(own, [*KEYS, "shot"]).join(central, [*KEYS, "shot"], "left").na.fill(0.0, ["centrality"])
    group = [*KEYS, "grp"]
    parts = (("centrality", p.rep_w_centrality), ("sharpness", p.rep_w_sharpness), ("log_duration", p.rep_w_duration), ("stability", p.rep_w_stability), ("exposure", p.rep_w_exposure))
    score = sum((rank01(name, group) * weight for name, weight in parts), F.lit(0.0))
    return rows.withColumn("score", score)


def representatives(members: DataFrame) -> DataFrame:
    """The best member of each group, the first on ties, with what the group adds up to."""
    best = F.max_by("shot", F.struct("score", -F.col("shot")))
    rows = members.groupBy(*KEYS, "grp").agg(best.alias("representative"), F.count(F.lit(1)).alias("occurrences"), F.min("start").alias("first_seen"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total_duration"), F.sort_array(F.collect_list("shot")).alias("shots"))
    unit = F.format_string("S%02d-U%02d", F.col("scene").cast("long"), F.col("grp") + 1)
    return rows.withColumn("unit", unit).withColumn("duplicates", F.array_except("shots", F.array("representative")))


def group_links(pairs: DataFrame, groups: DataFrame, p: Unique) -> DataFrame:
    """Groups of one scene that may be the same after all: video, scene, a, b, best probability of any two members."""
    a, b = groups.select(*KEYS, F.col("shot").alias("i"), F.col("grp").alias("a")), groups.select(*KEYS, F.col("shot").alias("j"), F.col("grp").alias("b"))
    rows = pairs.join(a, [*KEYS, "i"]).join(b, [*KEYS, "j"]).where("a <> b").select(*KEYS, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "prob")
    return rows.groupBy(*KEYS, "a", "b").agg(F.max("prob").alias("best")).where(F.col("best") >= p.different_threshold)


def summary(groups: DataFrame) -> DataFrame:
    """Shots and groups by scene, and of each video in all (scene null)."""
    rows = groups.groupBy("video", F.expr("scene"), "grp").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.rollup("video", "scene").agg(F.sum("n").alias("original"), F.count(F.lit(1)).alias("unique_shots")).where("video IS NOT NULL")
    return rows.withColumn("repeated", F.col("original") - F.col("unique_shots")).withColumn("reduction", F.round(1 - F.col("unique_shots") / F.col("original"), 4))
