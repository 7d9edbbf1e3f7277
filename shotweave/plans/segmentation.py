"""Queries over shots with features: similarity, scenes, repeated shots, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import coherence, metrics, scenes, suppress, timeline, unique
from ..params import Unique, replaced
from ..sources.adapters import EMBEDDING_GROUPING as P
from ..sources.adapters import embedding_shots, label_boundaries
from ..sources.tables import materialised
from .registry import query

U = Unique(bias=-3.9)
SCENE_SHOTS = 10

EMB = """e AS (SELECT vec_id // 50 AS video, vec_id % 50 AS shot, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings),
s AS (SELECT video, shot, shot * 4.0::DOUBLE AS start, shot * 4.0::DOUBLE + 4 AS "end", label, v,
  list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS clip,
  list_transform(v[1:16], lambda x: abs(x) / greatest(list_sum(list_transform(v[1:16], lambda y: abs(y))), 1e-9)) AS color FROM e),
d AS (SELECT video, max("end") AS duration, count(*) AS n FROM s GROUP BY video)"""
COLOR = "list_sum(list_transform(list_zip(a.color, b.color), lambda z: least(z[1], z[2])))"
CLIP = "list_inner_product(a.clip, b.clip)"
HASH = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: CAST((z[1] > 0) = (z[2] > 0) AS DOUBLE))) / 64"


def pairs_sql(w: int = P.window_shots, k: int | None = None) -> str:
    k = k or (1 if w == 1 else P.coherence_topk)
    return EMB + f""",
p AS (SELECT a.video, a.shot AS i, b.shot AS j, {P.clip_weight} * greatest(0, least(1, ({CLIP} + 1) / 2)) + {P.color_weight} * {COLOR} AS sim, b.start - a."end" AS gap
  FROM s a JOIN s b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= {2 * w - 1}),
l AS (SELECT video, unnest(range(greatest(i, j - {w}), least(j - 1, i + {w - 1}) + 1)) AS cut, i, j, sim - {P.distance_penalty} * (j - i - 1) AS value
  FROM p WHERE gap <= {P.window_seconds} OR j - i = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY video, cut ORDER BY value DESC, i DESC, j DESC) AS rank FROM l),
c AS (SELECT t.video, cut, (cut + 1) * 4.0::DOUBLE AS time, avg(value) AS coherence, 1 - avg(value) AS score, arg_max(i, -rank) AS best_i, arg_max(j, -rank) AS best_j
  FROM t JOIN d USING (video) WHERE rank <= greatest(1, least({k}, cut + 1, n - 1 - cut, {w})) GROUP BY t.video, cut)"""


CLIMB = """,
x AS (SELECT *, coalesce(CAST(lag(score) OVER q > score AS INTEGER), 0) AS falls, coalesce(CAST(lead(score) OVER q > score AS INTEGER), 0) AS rises
  FROM c WINDOW q AS (PARTITION BY video ORDER BY cut)),
y AS (SELECT *, sum(falls) OVER (PARTITION BY video ORDER BY cut) AS up, sum(rises) OVER (PARTITION BY video ORDER BY cut DESC) AS down FROM x),
z AS (SELECT video, cut, time, score, coherence, (score - first_value(score) OVER (PARTITION BY video, up ORDER BY cut)) + (score - first_value(score) OVER (PARTITION BY video, down ORDER BY cut DESC)) AS depth
  FROM y)"""
FIRST = f"""CASE WHEN score < {P.abs_threshold} THEN 'below_abs' WHEN score >= {P.strong_threshold} THEN '' WHEN depth < {P.depth_threshold} THEN 'below_depth' ELSE '' END"""


def fold_sql(source: str, strength: str, where: str, least: float) -> str:
    return f""",
o AS (SELECT video, time, duration, row_number() OVER (PARTITION BY video ORDER BY {strength} DESC, time) AS k FROM {source} JOIN d USING (video) WHERE {where}),
g AS (SELECT video, 0 AS k, [0.0::DOUBLE, duration] AS taken FROM d
  UNION ALL
  SELECT g.video, o.k, CASE WHEN list_min(list_transform(g.taken, lambda x: abs(x - o.time))) >= {least} THEN list_append(g.taken, o.time) ELSE g.taken END
  FROM g JOIN o ON o.video = g.video AND o.k = g.k + 1),
h AS (SELECT video, arg_max(taken, k)[3:] AS chosen FROM g GROUP BY video)"""


def decisions_sql(w: int = P.window_shots) -> str:
    return pairs_sql(w) + CLIMB + f", u AS (SELECT *, {FIRST} AS decision FROM z)" + fold_sql("u", "score", "decision = ''", P.min_scene_seconds) + """,
b AS (SELECT u.video, cut, time, score, depth, CASE WHEN decision <> '' THEN decision WHEN list_contains(chosen, time) THEN 'boundary' ELSE 'min_duration' END AS decision
  FROM u JOIN h USING (video))"""


SCENES = """,
bb AS (SELECT video, time AS t FROM {boundaries} UNION SELECT video, 0.0 FROM d),
sc AS (SELECT bb.video, row_number() OVER (PARTITION BY bb.video ORDER BY t) AS scene_id, t AS begin, coalesce(lead(t) OVER (PARTITION BY bb.video ORDER BY t), duration) AS finish
  FROM bb JOIN d USING (video)),
hs AS (SELECT sc.video, scene_id, min(shot) AS shot_start, max(shot) AS shot_end, count(shot) AS shot_count FROM sc LEFT
  JOIN s ON s.video = sc.video AND s.start >= begin - 1e-3 AND s.start < finish - 1e-3 GROUP BY sc.video, scene_id),
sn AS (SELECT video, scene_id, round(begin, 3) AS start_seconds, round(finish, 3) AS end_seconds, round(finish - begin, 3) AS duration_seconds, shot_start, shot_end, shot_count, (shot_start + shot_end) // 2 AS mid_shot
  FROM sc JOIN hs USING (video, scene_id))"""


def scenes_sql(w: int = P.window_shots) -> str:
    return f"WITH RECURSIVE {decisions_sql(w)}, bd AS (SELECT video, time FROM b WHERE decision = 'boundary')" + SCENES.format(boundaries="bd") + " SELECT * FROM sn"


def _scores(spark, sf_dir) -> DataFrame:
    shots = embedding_shots(spark, sf_dir)
    return coherence.coherence(coherence.pair_similarities(shots, P), shots, P)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {EMB} SELECT a.video, a.shot AS cut, round({CLIP}, 6) AS clip, round({COLOR}, 6) AS color FROM s a JOIN s b ON a.video = b.video AND b.shot = a.shot + 1")
def adjacent_similarity(spark, sf_dir):
    pairs = coherence.band_pairs(embedding_shots(spark, sf_dir), 1, ["clip", "color"])
    return pairs.select("video", F.col("i").alias("cut"), F.round(vec.dot("a_clip", "b_clip"), 6).alias("clip"), F.round(vec.intersection("a_color", "b_color"), 6).alias("color"))


@query(f"WITH {pairs_sql()} SELECT video, i, j, round(sim, 6) AS similarity, gap FROM p")
def band_pairs(spark, sf_dir):
    return _rounded(coherence.pair_similarities(embedding_shots(spark, sf_dir), P), "similarity").drop("start")


@query(f"WITH {EMB} SELECT a.video, a.shot AS i, b.shot AS j, round((0.6 * greatest(0, least(1, ({CLIP} - 0.1) / 0.9)) + 0.3 * {COLOR}) / 0.9, 6) AS blended FROM s a JOIN s b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= 3")
def blended_similarity(spark, sf_dir):
    pairs = coherence.band_pairs(embedding_shots(spark, sf_dir), 3, ["clip", "color"])
    value = vec.blended(vec.rescaled(vec.dot("a_clip", "b_clip"), 0.1), vec.intersection("a_color", "b_color"), 0.6, 0.3)
    return pairs.select("video", "i", "j", F.round(value, 6).alias("blended"))


@query(f"WITH {EMB} SELECT a.video, a.shot AS i, b.shot AS j, round({COLOR}, 6) AS color FROM s a JOIN s b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= 5")
def color_intersection(spark, sf_dir):
    pairs = coherence.band_pairs(embedding_shots(spark, sf_dir), 5, ["color"])
    return pairs.select("video", "i", "j", F.round(vec.intersection("a_color", "b_color"), 6).alias("color"))


@query(f"WITH {EMB} SELECT a.video, a.shot AS i, b.shot AS j, {HASH} AS agreement FROM s a JOIN s b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= 5")
def hamming_agreement(spark, sf_dir):
    pairs = coherence.band_pairs(embedding_shots(spark, sf_dir), 5, ["phash"])
    return pairs.select("video", "i", "j", vec.bit_agreement("a_phash", "b_phash").alias("agreement"))


@query("""WITH m AS (SELECT CAST(label AS BIGINT) AS label, i, avg(x / sqrt(list_inner_product(v, v))) AS x
  FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS v, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i
  FROM embeddings) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT label, i, round(x / norm, 6) AS x FROM m JOIN n USING (label)""")
def mean_vectors(spark, sf_dir):
    """The re-normalised mean of each label's normalised vectors, an element a row."""
    rows = embedding_shots(spark, sf_dir).select(F.col("label").alias("video"), F.lit(0).alias("shot"), "clip", "color")
    return coherence.mean_features(rows).select(F.col("video").alias("label"), F.posexplode("clip").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


TRIPLES = EMB + """,
w AS (SELECT video, shot // 3 AS shot, list(clip ORDER BY shot) AS frames FROM s GROUP BY video, shot // 3),
m AS (SELECT a.video, a.shot AS i, b.shot AS j, list_transform(a.frames, lambda x: list_transform(b.frames, lambda y: list_inner_product(x, y))) AS m,
  list_transform(b.frames, lambda y: list_transform(a.frames, lambda x: list_inner_product(x, y))) AS t FROM w a
  JOIN w b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= 2)"""


def _triples(spark, sf_dir) -> DataFrame:
    """Three vectors in a row as the frames of one shot."""
    rows = embedding_shots(spark, sf_dir).groupBy("video", F.floor(F.col("shot") / 3).alias("shot3")).agg(F.array_sort(F.collect_list(F.struct("shot", "clip"))).alias("fs"))
    return rows.select("video", F.col("shot3").alias("shot"), F.transform("fs", lambda x: x["clip"]).alias("frames"))


@query(f"""WITH {TRIPLES}, x AS (SELECT video, i, j, m, list_transform(m, lambda r: list_max(r)) AS r, list_transform(t, lambda r: list_max(r)) AS c FROM m)
SELECT video, i, j, round(list_max(flatten(m)), 6) AS best, round((list_avg(r) + list_avg(c)) / 2, 6) AS matched, round(least(list_min(r), list_min(c)), 6) AS worst
  FROM x""")
def frame_pair_measures(spark, sf_dir):
    pairs = coherence.band_pairs(_triples(spark, sf_dir), 2, ["frames"]).withColumn("m", vec.frame_similarities("a_frames", "b_frames"))
    return pairs.select("video", "i", "j", F.round(vec.best_frame(F.col("m")), 6).alias("best"), F.round(vec.matched(F.col("m")), 6).alias("matched"), F.round(vec.worst_matched(F.col("m")), 6).alias("worst"))


@query(f"""WITH {TRIPLES}
  SELECT video, shot, round(list_min(flatten(list_transform(frames, lambda x: list_transform(frames, lambda y: list_inner_product(x, y))))), 6) AS stability, round(1 - abs(shot / 20.0 - 0.45) / 0.55, 6) AS exposure
  FROM w""")
def stability_centrality_exposure(spark, sf_dir):
    return _triples(spark, sf_dir).select("video", "shot", F.round(vec.stability("frames"), 6).alias("stability"), F.round(1 - F.abs(F.col("shot") / 20.0 - 0.45) / 0.55, 6).alias("exposure"))


@query(f"WITH {pairs_sql()} SELECT video, cut, time, round(coherence, 6) AS coherence, round(score, 6) AS score, best_i, best_j FROM c")
def coherence_topk(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "coherence", "score")


@query(f"""WITH {pairs_sql()}
  SELECT video, cut, round(greatest(0, coalesce(score - min(score) OVER (q ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)) + greatest(0, coalesce(score - min(score) OVER (q ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0)), 6) AS depth
  FROM c WINDOW q AS (PARTITION BY video ORDER BY cut)""")
def depth_window(spark, sf_dir):
    return _rounded(coherence.depth_window(_scores(spark, sf_dir), P.window_shots // 2).select("video", "cut", "depth"), "depth")


@query(f"WITH {pairs_sql()}{CLIMB} SELECT video, cut, round(depth, 6) AS depth FROM z")
def depth_climb(spark, sf_dir):
    return _rounded(coherence.depth_climb(_scores(spark, sf_dir)).select("video", "cut", "depth"), "depth")


@query(f"WITH RECURSIVE {decisions_sql()} SELECT video, cut, time, round(score, 6) AS score, round(depth, 6) AS depth, decision FROM b")
def cut_decisions(spark, sf_dir):
    rows = scenes.cut_decisions(embedding_shots(spark, sf_dir), P)
    return _rounded(rows, "score", "depth").select("video", "cut", "time", "score", "depth", "decision")


@query(scenes_sql())
def scene_segmentation(spark, sf_dir):
    return scenes.segmented(embedding_shots(spark, sf_dir), P)


@query(scenes_sql(1))
def baseline_adjacent(spark, sf_dir):
    return scenes.segmented(embedding_shots(spark, sf_dir), scenes.adjacent_only(P))


@query(f"WITH {EMB}, bd AS (SELECT video, start AS time FROM s WHERE shot > 0)" + SCENES.format(boundaries="bd") + " SELECT * FROM sn")
def baseline_all_shots(spark, sf_dir):
    return scenes.every_cut(embedding_shots(spark, sf_dir))


@query(f"WITH RECURSIVE {decisions_sql()}, bd AS (SELECT video, time FROM b WHERE decision = 'boundary')" + SCENES.format(boundaries="bd") + " SELECT video, count(*) AS scene_count, max(end_seconds) AS duration_seconds, round(avg(duration_seconds), 6) AS mean_seconds, max(shot_count) AS most_shots FROM sn GROUP BY video")
def scene_summary(spark, sf_dir):
    rows = scenes.segmented(embedding_shots(spark, sf_dir), P)
    return rows.groupBy("video").agg(F.count(F.lit(1)).alias("scene_count"), F.max("end_seconds").alias("duration_seconds"), F.round(F.avg("duration_seconds"), 6).alias("mean_seconds"), F.max("shot_count").alias("most_shots"))


@query(f"WITH RECURSIVE {decisions_sql()}, bd AS (SELECT video, time FROM b WHERE decision = 'boundary')" + SCENES.format(boundaries="bd") + " SELECT video, scene_id, mid_shot, printf('scene_%03d.mp4', scene_id) AS file FROM sn")
def mid_shot(spark, sf_dir):
    rows = scenes.segmented(embedding_shots(spark, sf_dir), P)
    return rows.select("video", "scene_id", "mid_shot").join(scenes.clip_plan(rows).select("video", "scene_id", "file"), ["video", "scene_id"])


@query(f"""WITH {pairs_sql()}
  SELECT video, cut, round(score - median(score) OVER (PARTITION BY video ORDER BY cut ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS score_rel
  FROM c""")
def local_median_score(spark, sf_dir):
    w = Window.partitionBy("video").orderBy("cut").rowsBetween(-5, 5)
    return _scores(spark, sf_dir).select("video", "cut", F.round(F.col("score") - F.percentile("score", 0.5).over(w), 6).alias("score_rel"))


# --- repeated shots --------------------------------------------------------------------------------
IN_SCENE = EMB + f""",
i AS (SELECT *, shot // {SCENE_SHOTS} AS scene FROM s),
pp AS (SELECT a.video, a.scene, a.shot AS i, b.shot AS j, {CLIP} AS clip, {COLOR} AS color, {HASH} AS phash FROM i a
  JOIN i b ON a.video = b.video AND a.scene = b.scene AND a.shot < b.shot),
pr AS (SELECT *, 1 / (1 + exp(-({U.w_clip} * clip + {U.w_color} * color + {U.w_phash} * phash + {U.bias}))) AS prob FROM pp)"""
SINGLE = IN_SCENE + f""",
ed AS (SELECT video, scene, i AS a, j AS b FROM pr WHERE prob >= {U.duplicate_threshold} UNION SELECT video, scene, j, i FROM pr WHERE prob >= {U.duplicate_threshold}),
rc AS (SELECT video, scene, shot, shot AS root FROM i UNION SELECT rc.video, rc.scene, ed.b, rc.root FROM rc
  JOIN ed ON ed.video = rc.video AND ed.scene = rc.scene AND ed.a = rc.shot),
rt AS (SELECT video, scene, shot, min(root) AS root FROM rc GROUP BY video, scene, shot),
gp AS (SELECT video, scene, shot, dense_rank() OVER (PARTITION BY video, scene ORDER BY root) - 1 AS grp FROM rt)"""


def _scene_shots(spark, sf_dir) -> DataFrame:
    rows = embedding_shots(spark, sf_dir).withColumn("scene", F.floor(F.col("shot") / SCENE_SHOTS))
    return rows.withColumns({"has_thumb": F.lit(True), "sharpness": F.col("label").cast("double"), "brightness": F.col("shot") / 50.0})


SINGLE_U = replaced(U, linkage="single")


def _single(spark, sf_dir):
    shots = _scene_shots(spark, sf_dir)
    pairs = materialised(unique.scene_pairs(shots, SINGLE_U), "pairs")
    return shots, pairs, materialised(unique.clusters(shots, pairs, SINGLE_U), "clusters")


@query(f"WITH {IN_SCENE} SELECT video, scene, i, j, round(prob, 6) AS prob FROM pr")
def duplicate_probability(spark, sf_dir):
    return _rounded(unique.scene_pairs(_scene_shots(spark, sf_dir), U), "prob").select("video", "scene", "i", "j", "prob")


@query(f"WITH {IN_SCENE} SELECT CASE WHEN prob >= {U.duplicate_threshold} THEN 'duplicate' WHEN prob >= {U.different_threshold} THEN 'uncertain' ELSE 'different' END AS state, count(*) AS n FROM pr GROUP BY 1")
def duplicate_state(spark, sf_dir):
    pairs = unique.scene_pairs(_scene_shots(spark, sf_dir), U)
    return pairs.groupBy(unique.state(F.col("prob"), U).alias("state")).agg(F.count(F.lit(1)).alias("n"))


# The clusters of a scene as a list of lists of places, and one merge a step: the nearest two, the first on ties.
@query(f"""WITH RECURSIVE {IN_SCENE},
mx AS (SELECT a.video, a.scene, list(a.shot ORDER BY a.shot) AS ids, list(a.row ORDER BY a.shot) AS m FROM (
  SELECT a.video, a.scene, a.shot, list(coalesce(1 - prob, 0) ORDER BY b.shot) AS row FROM i a JOIN i b ON a.video = b.video AND a.scene = b.scene
    LEFT JOIN pr ON pr.video = a.video AND pr.scene = a.scene AND pr.i = least(a.shot, b.shot) AND pr.j = greatest(a.shot, b.shot) GROUP BY a.video, a.scene, a.shot) a
  GROUP BY a.video, a.scene),
gr AS (SELECT video, scene, ids, m, list_transform(range(1, len(ids) + 1), lambda k: [k]) AS sets, 0 AS step FROM mx
  UNION ALL
  SELECT video, scene, ids, m, list_filter(list_transform(range(1, len(sets) + 1), lambda k: CASE WHEN k = near.a THEN list_concat(sets[k], sets[near.b]) WHEN k = near.b THEN [] ELSE sets[k] END), lambda x: len(x) > 0), step + 1 FROM (
    SELECT *, list_min(flatten(list_transform(range(1, len(sets) + 1), lambda a: list_transform(range(a + 1, len(sets) + 1), lambda b: struct_pack(
      d := round(list_avg(flatten(list_transform(sets[a], lambda x: list_transform(sets[b], lambda y: m[x][y])))), 12), a := a, b := b))))) AS near FROM gr WHERE len(sets) > 1)
  WHERE near.d <= 1 - {U.duplicate_threshold} + 1e-12),
fs AS (SELECT video, scene, arg_max(ids, step) AS ids, arg_max(sets, step) AS sets FROM gr GROUP BY video, scene),
fg AS (SELECT video, scene, ids, unnest(sets) AS members, unnest(range(0, len(sets))) AS grp FROM fs)
SELECT video, scene, ids[unnest(members)] AS shot, grp FROM fg""")
def unique_shots_average_linkage(spark, sf_dir):
    shots = _scene_shots(spark, sf_dir)
    return unique.clusters(shots, materialised(unique.scene_pairs(shots, U), "pairs"), U)


@query(f"WITH RECURSIVE {SINGLE} SELECT * FROM gp")
def unique_shots_components(spark, sf_dir):
    return _single(spark, sf_dir)[2]


RANKED = SINGLE + f""",
ct AS (SELECT g.video, g.scene, g.shot, avg(prob) AS c FROM gp g
  JOIN gp o ON o.video = g.video AND o.scene = g.scene AND o.grp = g.grp AND o.shot <> g.shot
  JOIN pr ON pr.video = g.video AND pr.i = least(g.shot, o.shot) AND pr.j = greatest(g.shot, o.shot) GROUP BY g.video, g.scene, g.shot),
mb AS (SELECT g.*, coalesce(c, 0) AS centrality, ln(1 + s.label::DOUBLE) AS sharpness, 1 - abs(g.shot / 50.0 - 0.45) / 0.55 AS exposure FROM gp g
  JOIN s USING (video, shot) LEFT JOIN ct USING (video, scene, shot)),
rk AS (SELECT *, count(*) OVER w AS n, rank() OVER (w ORDER BY centrality) + (count(*) OVER (PARTITION BY video, scene, grp, centrality) - 1) / 2 AS r1,
  rank() OVER (w ORDER BY sharpness) + (count(*) OVER (PARTITION BY video, scene, grp, sharpness) - 1) / 2 AS r2, rank() OVER (w ORDER BY exposure) + (count(*) OVER (PARTITION BY video, scene, grp, exposure) - 1) / 2 AS r3
  FROM mb WINDOW w AS (PARTITION BY video, scene, grp)),
sr AS (SELECT *, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE {U.rep_w_centrality} * (r1 - 1) / (n - 1) + {U.rep_w_sharpness} * (r2 - 1) / (n - 1) + {U.rep_w_exposure} * (r3 - 1) / (n - 1) + {U.rep_w_duration + U.rep_w_stability} * 0.5 END AS score
  FROM rk)"""


@query(f"WITH RECURSIVE {RANKED} SELECT video, scene, grp, shot, round(CASE WHEN n = 1 THEN 1 ELSE (r1 - 1) / (n - 1) END, 6) AS centrality_rank, round(score, 6) AS score FROM sr")
def average_rank(spark, sf_dir):
    shots, pairs, groups = _single(spark, sf_dir)
    rows = unique.scored_members(shots, pairs, groups, SINGLE_U)
    return rows.select("video", "scene", "grp", "shot", F.round(unique.rank01("centrality", ["video", "scene", "grp"]), 6).alias("centrality_rank"), F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {RANKED} SELECT video, scene, grp, arg_max(shot, round(score, 9) * 1000000 - shot / 1000.0) AS representative, count(*) AS occurrences, min(shot) * 4.0::DOUBLE AS first_seen, count(*) * 4.0::DOUBLE AS total_duration, printf('S%02d-U%02d', scene, grp + 1) AS unit FROM sr GROUP BY video, scene, grp")
def representative(spark, sf_dir):
    shots, pairs, groups = _single(spark, sf_dir)
    members = unique.scored_members(shots, pairs, groups, SINGLE_U).withColumn("score", F.round("score", 9))
    return unique.representatives(members).select("video", "scene", "grp", "representative", "occurrences", "first_seen", "total_duration", "unit")


@query(f"""WITH RECURSIVE {SINGLE} SELECT pr.video, pr.scene, least(a.grp, b.grp) AS a, greatest(a.grp, b.grp) AS b, round(max(prob), 6) AS best FROM pr
JOIN gp a ON a.video = pr.video AND a.shot = pr.i JOIN gp b ON b.video = pr.video AND b.shot = pr.j WHERE a.grp <> b.grp
  GROUP BY ALL HAVING max(prob) >= {U.different_threshold}""")
def group_links(spark, sf_dir):
    _, pairs, groups = _single(spark, sf_dir)
    return _rounded(unique.group_links(pairs, groups, SINGLE_U), "best")


@query(f"""WITH RECURSIVE {SINGLE}, k AS (SELECT video, scene, grp, count(*) AS n FROM gp GROUP BY ALL)
SELECT video, scene, CAST(sum(n) AS BIGINT) AS original, count(*) AS unique_shots, CAST(sum(n) AS BIGINT) - count(*) AS repeated, round(1 - count(*) / sum(n), 4) AS reduction
  FROM k GROUP BY GROUPING SETS ((video), (video, scene))""")
def unique_summary_rollup(spark, sf_dir):
    return unique.summary(_single(spark, sf_dir)[2])


@query(f"WITH {EMB} SELECT video, shot, label, dense_rank() OVER (PARTITION BY video ORDER BY f) - 1 AS cluster FROM (SELECT *, min(shot) OVER (PARTITION BY video, label) AS f FROM s)")
def cluster_relabel(spark, sf_dir):
    """Labels renumbered by first appearance."""
    first = F.min("shot").over(Window.partitionBy("video", "label"))
    rows = embedding_shots(spark, sf_dir).withColumn("f", first)
    return rows.select("video", "shot", "label", (F.dense_rank().over(Window.partitionBy("video").orderBy("f")) - 1).cast("long").alias("cluster"))


# --- metrics ---------------------------------------------------------------------------------------
TRUTH = """,
tr AS (SELECT video, start AS time FROM (SELECT *, lag(label) OVER (PARTITION BY video ORDER BY shot) AS before FROM s) WHERE before <> label),
bd AS (SELECT video, time FROM b WHERE decision = 'boundary')"""


def _truth(spark, sf_dir) -> DataFrame:
    """Where the label changes."""
    return materialised(label_boundaries(embedding_shots(spark, sf_dir)), "truth")


def _predicted(spark, sf_dir, p=P) -> DataFrame:
    return materialised(scenes.cut_decisions(embedding_shots(spark, sf_dir), p).where("decision = 'boundary'").select("video", "time"), "predicted")


def _videos(spark, sf_dir) -> DataFrame:
    return scenes.durations(embedding_shots(spark, sf_dir))


#: True boundaries some way off their shot's start, so that most match at unequal times.
OFF = 0.37
MATCHED = (2.0, 4.0, 8.0)


# Predictions one by one, each with the best value of the first j truths: pairs count 1e6, less their error.
@query(f"""WITH RECURSIVE {decisions_sql()}{TRUTH},
to_ AS (SELECT video, list(time + {OFF} * (CAST(time AS BIGINT) // 4 % 11 - 5) ORDER BY time + {OFF} * (CAST(time AS BIGINT) // 4 % 11 - 5)) AS held FROM tr GROUP BY video),
po AS (SELECT video, time, row_number() OVER (PARTITION BY video ORDER BY time) AS k FROM bd),
md AS (SELECT video, tol, 0 AS k, held, list_transform(range(0, len(held) + 1), lambda j: 0.0::DOUBLE) AS best FROM to_, (SELECT unnest([{', '.join(map(str, MATCHED))}]::DOUBLE[]) AS tol)
  UNION ALL
  SELECT video, tol, k, held, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT md.video, tol, po.k, held, list_prepend(best[1], list_transform(range(1, len(held) + 1), lambda j: greatest(best[j + 1], CASE WHEN abs(po.time - held[j]) <= tol
      THEN best[j] + 1e6 - abs(po.time - held[j]) ELSE -1 END))) AS c FROM md JOIN po ON po.video = md.video AND po.k = md.k + 1)),
ml AS (SELECT video, tol AS tolerance, arg_max(best[len(best)], k) AS value FROM md GROUP BY video, tol)
SELECT video, tolerance, CAST(ceil(value / 1e6) AS BIGINT) AS pairs, round(ceil(value / 1e6) * 1e6 - value, 4) AS error FROM ml WHERE value > 0""")
def boundary_match(spark, sf_dir):
    """How many boundaries match one to one, and their total error."""
    off = F.col("time") + OFF * (F.pmod(F.floor(F.col("time") / 4), F.lit(11)) - 5)
    pairs = metrics.matched(_predicted(spark, sf_dir), _truth(spark, sf_dir).select("video", off.alias("time")), MATCHED)
    return pairs.groupBy("video", "tolerance").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("error"), 4).alias("error"))


# Boundaries are 4 s apart, so within 3 s only equal ones match.
PRF = """,
hit AS (SELECT video, count(*) AS tp FROM bd JOIN tr USING (video, time) GROUP BY video),
np AS (SELECT d.video, (SELECT count(*) FROM bd WHERE bd.video = d.video) AS n_pred, (SELECT count(*) FROM tr
  WHERE tr.video = d.video) AS n_true, coalesce((SELECT tp FROM hit WHERE hit.video = d.video), 0) AS tp FROM d),
pf AS (SELECT video, tol.t AS tolerance, tp, n_pred - tp AS fp, n_true - tp AS fn, CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN n_true > 0 THEN tp / n_true ELSE 1.0 END AS r, CASE WHEN tp > 0 THEN 0.0::DOUBLE END AS mean_abs_error
  FROM np, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) tol(t)),
pf1 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pf)"""
OVERLAP = """,
ps AS (SELECT video, t AS pb, coalesce(lead(t) OVER (PARTITION BY video ORDER BY t), duration) AS pf FROM (SELECT video, time AS t FROM bd UNION
  SELECT video, 0.0 FROM d) JOIN d USING (video)),
gs AS (SELECT video, t AS begin, coalesce(lead(t) OVER (PARTITION BY video ORDER BY t), duration) AS finish FROM (SELECT video, time AS t
  FROM tr UNION SELECT video, 0.0 FROM d) JOIN d USING (video)),
gn AS (SELECT *, finish - begin AS len, coalesce(lag(finish - begin) OVER (PARTITION BY video ORDER BY begin), 0) + coalesce(lead(finish - begin) OVER (PARTITION BY video ORDER BY begin), 0) AS neighbours
  FROM gs),
ov AS (SELECT gn.video, begin, len, neighbours, max(least(pf, finish) - greatest(pb, begin)) AS most, sum(pf - pb - (least(pf, finish) - greatest(pb, begin))) AS spill
  FROM gn JOIN ps ON ps.video = gn.video AND pb < finish AND begin < pf GROUP BY ALL),
co AS (SELECT video, sum(most) / sum(len) AS coverage, sum(CASE WHEN neighbours > 0 THEN len * least(1, spill / neighbours) ELSE 0 END) / sum(len) AS overflow
  FROM ov GROUP BY video),
cf AS (SELECT *, CASE WHEN coverage + 1 - overflow > 0 THEN 2 * coverage * (1 - overflow) / (coverage + 1 - overflow) ELSE 0 END AS f_co FROM co)"""


@query(f"WITH RECURSIVE {decisions_sql()}{TRUTH}{PRF} SELECT video, tolerance, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, mean_abs_error FROM pf1")
def prf_by_tolerance(spark, sf_dir):
    return _rounded(metrics.prf(_predicted(spark, sf_dir), _truth(spark, sf_dir), _videos(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH RECURSIVE {decisions_sql()}{TRUTH}{OVERLAP} SELECT video, round(coverage, 6) AS coverage, round(overflow, 6) AS overflow, round(f_co, 6) AS f_co FROM cf")
def coverage_overflow(spark, sf_dir):
    return _rounded(metrics.coverage_overflow(_predicted(spark, sf_dir), _truth(spark, sf_dir), _videos(spark, sf_dir)), "coverage", "overflow", "f_co")


RECORD = "round(coverage, 6) AS coverage, round(overflow, 6) AS overflow, round(f_co, 6) AS f_co"


@query(f"""WITH RECURSIVE {decisions_sql()}{TRUTH}{PRF}{OVERLAP}
  SELECT video, tolerance, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, mean_abs_error,
{RECORD}, tp + fp + 1 AS n_pred_scenes, tp + fn + 1 AS n_true_scenes, round((tp + fp + 1) / (tp + fn + 1), 6) AS count_ratio FROM pf1 JOIN cf USING (video)""")
def full_metric_record(spark, sf_dir):
    rows = metrics.records(_predicted(spark, sf_dir), _truth(spark, sf_dir), _videos(spark, sf_dir))
    return _rounded(rows, "precision", "recall", "f1", "coverage", "overflow", "f_co", "count_ratio")


MACRO = """round(avg(f1), 6) AS macro_f1, round(coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0), 6) AS micro_precision, round(coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0), 6) AS micro_recall"""


@query(f"""WITH RECURSIVE {decisions_sql()}{TRUTH}{PRF}{OVERLAP} SELECT tolerance, count(*) AS videos, {MACRO}, avg(mean_abs_error) AS mean_abs_error,
round(avg(coverage), 6) AS coverage, round(avg(overflow), 6) AS overflow, round(avg(f_co), 6) AS f_co, round(avg((tp + fp + 1) / (tp + fn + 1)), 6) AS count_ratio,
round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM pf1 JOIN cf USING (video) GROUP BY tolerance""")
def metric_macro_micro(spark, sf_dir):
    rows = metrics.summarised(metrics.records(_predicted(spark, sf_dir), _truth(spark, sf_dir), _videos(spark, sf_dir)), [])
    return _rounded(rows, "macro_f1", "micro_precision", "micro_recall", "coverage", "overflow", "f_co", "count_ratio", "micro_f1")


SUMMARY = f"""{MACRO}, avg(mean_abs_error) AS mean_abs_error,
round(avg(coverage), 6) AS coverage, round(avg(overflow), 6) AS overflow, round(avg(f_co), 6) AS f_co,
round(avg((tp + fp + 1) / (tp + fn + 1)), 6) AS count_ratio, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1"""


def _method_sql(name: str, with_boundaries: str) -> str:
    return f"""SELECT '{name}' AS method, * FROM (WITH RECURSIVE {with_boundaries}{PRF}{OVERLAP}
SELECT tolerance, count(*) AS videos, {SUMMARY} FROM pf1 JOIN cf USING (video) GROUP BY tolerance)"""


ALL_CUTS = EMB + TRUTH.split(",\nbd AS")[0] + ",\nbd AS (SELECT video, start AS time FROM s WHERE shot > 0)"


@query("\nUNION ALL\n".join([_method_sql("rule", decisions_sql() + TRUTH), _method_sql("adjacent", decisions_sql(1) + TRUTH), _method_sql("all", ALL_CUTS)]))
def method_comparison(spark, sf_dir):
    """All methods over all videos in one table, as an evaluation run reports them."""
    truth, videos = _truth(spark, sf_dir), _videos(spark, sf_dir)
    shots = embedding_shots(spark, sf_dir)
    said = {
        "rule": _predicted(spark, sf_dir),
        "adjacent": _predicted(spark, sf_dir, scenes.adjacent_only(P)),
        "all": shots.where("shot > 0").select("video", F.col("start").alias("time")),
    }
    rows = None
    for name, pred in said.items():
        one = metrics.records(pred, truth, videos).withColumn("method", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    rows = metrics.summarised(rows, ["method"])
    return _rounded(rows, "macro_f1", "micro_precision", "micro_recall", "coverage", "overflow", "f_co", "count_ratio", "micro_f1")


@query(f"WITH RECURSIVE {pairs_sql()}" + fold_sql("c", "score", "score >= 0.4", 14.0) + " SELECT video, CAST(k AS BIGINT) AS place, time FROM (SELECT video, unnest(chosen) AS time, unnest(range(1, len(chosen) + 1)) AS k FROM h)")
def suppression_order(spark, sf_dir):
    """The order in which cuts are taken, strongest first."""
    shots = embedding_shots(spark, sf_dir)
    cuts = _scores(spark, sf_dir).join(scenes.durations(shots), "video").where("score >= 0.4")
    rows = suppress.chosen_times(cuts, F.col("score"), 14.0)
    return rows.select("video", F.posexplode("chosen").alias("place", "time")).select("video", (F.col("place") + 1).cast("long").alias("place"), "time")


@query(f"""WITH {EMB} SELECT video, shot // 7 AS scene, shot, start FROM s WHERE start <= 77.5 AND start + 4 > 77.5""")
def point_lookup(spark, sf_dir):
    """The shot on screen at one moment of each video."""
    rows = embedding_shots(spark, sf_dir).where((F.col("start") <= 77.5) & (F.col("end") > 77.5))
    return rows.select("video", F.floor(F.col("shot") / 7).alias("scene"), "shot", "start")


@query(f"""WITH {EMB}, k AS (SELECT a.video, a.shot AS i, b.shot AS j, {CLIP} AS clip FROM s a
  JOIN s b ON a.video = b.video AND b.shot > a.shot AND b.shot - a.shot <= 40 AND a.shot // 10 = b.shot // 10),
b AS (SELECT *, least(7, greatest(0, CAST(floor((clip + 0.4) * 10) AS BIGINT))) AS bin FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY bin, video ORDER BY i, j) AS turn FROM b) SELECT bin, video, i, j
  FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY turn, video) AS place FROM t) WHERE place <= 24""")
def sampled_pairs(spark, sf_dir):
    """Pairs of one scene for labelling: from each bin of similarity 24, taken in turn from the videos."""
    from ..operators.diagnose import round_robin

    shots = embedding_shots(spark, sf_dir).withColumn("scene", F.floor(F.col("shot") / 10))
    pairs = coherence.band_pairs(shots, 40, ["clip", "scene"]).where("a_scene = b_scene").withColumn("clip", vec.dot("a_clip", "b_clip"))
    binned = pairs.withColumn("bin", F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.col("clip") + 0.4) * 10))))
    return round_robin(binned, "bin", "video", ["i", "j"], 24).select("bin", "video", "i", "j")


SCENE_FRAMES = 3
#: Structural similarity of two vectors as of two pictures without windows.
MEASURES = ("mean", "best", "matched", "worst", "color", "phash", "structure")
COMBINATIONS = {"matched+color": ["matched", "color"], "matched+phash": ["matched", "phash"], "matched+structure": ["matched", "structure"], "matched+color+phash+structure": ["matched", "color", "phash", "structure"]}
#: Pairs of shots of a scene by all measures. A shot's frames are its vector and those of the next shots, as far as its scene has them.
STUDY = IN_SCENE + f""",
fm AS (SELECT a.video, a.scene, a.shot, list(b.clip ORDER BY b.shot) AS frames FROM i a JOIN i b ON b.video = a.video AND b.scene = a.scene AND b.shot >= a.shot AND b.shot < a.shot + {SCENE_FRAMES} GROUP BY ALL),
ma AS (SELECT video, scene, shot, list_transform(range(1, len(frames[1]) + 1), lambda k: list_avg(list_transform(frames, lambda f: f[k]))) AS m FROM fm),
mu AS (SELECT video, scene, shot, list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-9)) AS mean FROM ma),
st AS (SELECT pr.video, pr.scene, pr.i, pr.j, pr.color, pr.phash, sa.label = sb.label AS same, list_inner_product(ua.mean, ub.mean) AS mean, fa.frames AS fa, fb.frames AS fb,
  list_transform(fa.frames, lambda x: list_transform(fb.frames, lambda y: list_inner_product(x, y))) AS m, list_transform(fb.frames, lambda y: list_transform(fa.frames, lambda x: list_inner_product(x, y))) AS t,
  list_avg(sa.clip) AS ea, list_avg(sb.clip) AS eb, list_inner_product(sa.clip, sa.clip) / len(sa.clip) AS qa, list_inner_product(sb.clip, sb.clip) / len(sb.clip) AS qb, list_inner_product(sa.clip, sb.clip) / len(sa.clip) AS qq
  FROM pr JOIN i sa ON sa.video = pr.video AND sa.shot = pr.i JOIN i sb ON sb.video = pr.video AND sb.shot = pr.j
  JOIN fm fa ON fa.video = pr.video AND fa.shot = pr.i JOIN fm fb ON fb.video = pr.video AND fb.shot = pr.j
  JOIN mu ua ON ua.video = pr.video AND ua.shot = pr.i JOIN mu ub ON ub.video = pr.video AND ub.shot = pr.j),
lb AS (SELECT video, i, j, same, color, phash, mean, list_max(flatten(m)) AS best, (list_avg(list_transform(m, lambda r: list_max(r))) + list_avg(list_transform(t, lambda r: list_max(r)))) / 2 AS matched,
  least(list_min(list_transform(m, lambda r: list_max(r))), list_min(list_transform(t, lambda r: list_max(r)))) AS worst,
  (2 * ea * eb + 1e-4) * (2 * (qq - ea * eb) + 9e-4) / ((ea * ea + eb * eb + 1e-4) * (qa - ea * ea + qb - eb * eb + 9e-4)) AS structure FROM st)"""


def _study_pairs(spark, sf_dir):
    from pyspark.sql import Window

    shots = _scene_shots(spark, sf_dir)
    after = F.collect_list("clip").over(Window.partitionBy("video", "scene").orderBy("shot").rowsBetween(0, SCENE_FRAMES - 1))
    mean = vec.normalized(vec.mean_of("frames"))
    shots = materialised(shots.withColumn("frames", after).withColumn("average", mean), "study-shots")
    one = lambda s, i: shots.select("video", "scene", F.col("shot").alias(i), *[F.col(c).alias(f"{s}_{c}") for c in ("clip", "frames", "average", "label")])
    pairs = unique.scene_pairs(shots.drop("frames"), U).drop("clip", "prob").join(one("a", "i"), ["video", "scene", "i"]).join(one("b", "j"), ["video", "scene", "j"])
    pairs = pairs.withColumn("m", vec.frame_similarities("a_frames", "b_frames"))
    told = {"mean": vec.dot("a_average", "b_average"), "best": vec.best_frame(F.col("m")), "matched": vec.matched(F.col("m")), "worst": vec.worst_matched(F.col("m")), "structure": vec.structure("a_clip", "b_clip")}
    return materialised(pairs.select("video", "i", "j", (F.col("a_label") == F.col("b_label")).alias("same"), "color", "phash", *[c.alias(n) for n, c in told.items()]), "study")


@query(f"""WITH {STUDY},
ms AS (SELECT video, same, measure, round(value, 9) AS value FROM (UNPIVOT (SELECT video, i, j, same, {', '.join(MEASURES)} FROM lb) ON {', '.join(MEASURES)} INTO NAME measure VALUE value)),
rk AS (SELECT *, rank() OVER (PARTITION BY measure ORDER BY value) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2 AS r FROM ms),
au AS (SELECT measure, count(*) AS n, (sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2) / (count(*) FILTER (same) * count(*) FILTER (NOT same)) AS auc
  FROM rk GROUP BY measure),
vl AS (SELECT measure, value, count(*) AS c, count(*) FILTER (same) AS p FROM ms GROUP BY measure, value),
cm AS (SELECT *, sum(p) OVER (PARTITION BY measure ORDER BY value DESC) AS tp, sum(c) OVER (PARTITION BY measure ORDER BY value DESC) AS said, sum(p) OVER (PARTITION BY measure) AS ap
  FROM vl),
ov AS (SELECT g.video, m.measure, m.value, count(*) AS c, count(*) FILTER (same) AS p FROM (SELECT DISTINCT video FROM ms) g JOIN ms m ON m.video <> g.video GROUP BY ALL),
oc AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS said, sum(p) OVER (PARTITION BY video, measure) AS ap, lag(value) OVER (PARTITION BY video, measure ORDER BY value) AS below
  FROM ov WINDOW w AS (PARTITION BY video, measure ORDER BY value DESC)),
ob AS (SELECT video, measure, arg_max((value + below) / 2, (2 * tp / (said + ap), -value)) AS threshold FROM oc WHERE below IS NOT NULL GROUP BY video, measure),
oh AS (SELECT measure, 2 * count(*) FILTER (value >= threshold AND same) / (2 * count(*) FILTER (value >= threshold AND same) + count(*) FILTER (value >= threshold AND NOT same) + count(*) FILTER (value < threshold AND same)) AS h
  FROM ms JOIN ob USING (video, measure) GROUP BY measure)
SELECT measure, n, round(auc, 6) AS auc, round(sum(p * tp / said) / max(ap), 6) AS ap, round(max(2 * tp / (said + ap)) FILTER (value > low), 6) AS f1, round(any_value(h), 6) AS held_out_f1
  FROM au JOIN cm USING (measure) JOIN (SELECT measure, min(value) AS low FROM vl GROUP BY measure) USING (measure) JOIN oh USING (measure) GROUP BY measure, n, auc""")
def similarity_study(spark, sf_dir):
    """How well each similarity tells shots of one label from others, and when its threshold is chosen on the other videos."""
    from ..operators.diagnose import measure_study

    return _rounded(measure_study(_study_pairs(spark, sf_dir), list(MEASURES), "same", "video"), "auc", "ap", "f1", "held_out_f1").drop("threshold")


# Newton steps of all left-out videos and pairs of measures at once; three unknowns by Cramer's rule.
@query(f"""WITH RECURSIVE {STUDY},
cq AS (SELECT * FROM (SELECT video, i, j, CAST(same AS INTEGER) AS y, matched AS x1, unnest([struct_pack(n := 'color', x := color), struct_pack(n := 'phash', x := phash), struct_pack(n := 'structure', x := structure)]) AS o FROM lb)),
ce AS (SELECT video, i, j, y, x1, o.x AS x2, o.n AS combo FROM cq),
nw AS (SELECT DISTINCT combo, video AS without, 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM ce
  UNION ALL
  SELECT combo, without, step + 1, b0 - (g0 * (c * f - d * d) - a * (g1 * f - d * g2) + b * (g1 * d - c * g2)) / det,
    b1 - (h * (g1 * f - d * g2) - g0 * (a * f - d * b) + b * (a * g2 - g1 * b)) / det, b2 - (h * (c * g2 - g1 * d) - a * (a * g2 - g1 * b) + g0 * (a * d - c * b)) / det
  FROM (SELECT *, h * (c * f - d * d) - a * (a * f - d * b) + b * (a * d - c * b) AS det FROM (
    SELECT combo, without, step, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * x1) + b1 AS g1, sum((p - y) * x2) + b2 AS g2, sum(p * (1 - p)) AS h, sum(p * (1 - p) * x1) AS a, sum(p * (1 - p) * x2) AS b,
      sum(p * (1 - p) * x1 * x1) + 1 AS c, sum(p * (1 - p) * x1 * x2) AS d, sum(p * (1 - p) * x2 * x2) + 1 AS f
    FROM (SELECT nw.*, y, x1, x2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM nw JOIN ce ON ce.combo = nw.combo AND ce.video <> nw.without WHERE step < 25)
    GROUP BY combo, without, step, b0, b1, b2)))
SELECT 'matched+' || combo AS combination, video, i, j, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 6) AS p FROM ce JOIN (SELECT * FROM nw WHERE step = 25) nw USING (combo) WHERE video = without""")
def combined_similarity(spark, sf_dir):
    """Two measures together: each pair's probability by a model of the other videos."""
    from ..operators.diagnose import combined

    two = {n: m for n, m in COMBINATIONS.items() if len(m) == 2}
    rows = combined(_study_pairs(spark, sf_dir), two, "same", "video", ["video", "i", "j"])
    told = [F.struct(F.lit(n).alias("combination"), F.round(F.col(f"`{n}`"), 6).alias("p")) for n in two]
    return rows.select("video", "i", "j", F.inline(F.array(*told))).select("combination", "video", "i", "j", "p")


@query()
def similarity_combinations(spark, sf_dir):
    """The study of the combinations, each score from a model that didn't see the pair's video."""
    from ..operators.diagnose import combined, measure_study

    rows = combined(_study_pairs(spark, sf_dir), COMBINATIONS, "same", "video", ["video", "i", "j"])
    return _rounded(measure_study(materialised(rows, "combinations"), list(COMBINATIONS), "same", "video"), "auc", "ap", "f1", "held_out_f1").drop("threshold")
