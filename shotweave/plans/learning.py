"""Queries of the learned boundary classifier and of tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence, experiment, learn, scenes, tune
from ..sources.adapters import EMBEDDING_GROUPING as P
from ..sources.adapters import SHOT_SECONDS, embedding_shots, event_frames
from ..sources.tables import materialised
from .registry import query
from .segmentation import CLIMB, CLIP, COLOR, EMB, TRUTH, _predicted, _truth, _videos, decisions_sql, fold_sql, pairs_sql


@query(f"""WITH {pairs_sql()}, k AS (SELECT p.*, unnest(range(i - 4, j + 4)) AS cut FROM p WHERE j - i < 8),
b AS (SELECT video, cut, avg(sim) FILTER (i <= cut AND j > cut) AS cross_mean, avg(sim) FILTER (j <= cut) AS left_coherence, avg(sim) FILTER (i > cut) AS right_coherence
  FROM k WHERE i >= cut - 3 AND j <= cut + 4 GROUP BY video, cut)
SELECT c.video, c.cut, round(coalesce(cross_mean, 0), 6) AS cross_mean, round(coalesce(left_coherence, 1), 6) AS left_coherence, round(coalesce(right_coherence, 1), 6) AS right_coherence
  FROM c LEFT JOIN b ON b.video = c.video AND b.cut = c.cut""")
def block_means(spark, sf_dir):
    shots = embedding_shots(spark, sf_dir)
    pairs = coherence.pair_similarities(shots, P)
    out = learn.block_means(pairs, coherence.coherence(pairs, shots, P))
    return out.withColumns({c: F.round(c, 6) for c in ("cross_mean", "left_coherence", "right_coherence")})


def _other_width_sql(w: int, k: int) -> str:
    return f"(WITH {pairs_sql(w, k)} SELECT video, cut, score FROM c)"


NEAR_CUT = "PARTITION BY video ORDER BY cut ROWS BETWEEN"
#: Frames of the user whose number a video has, four seconds each: every event is one.
FEATURES_SQL = f"""WITH {pairs_sql()}{CLIMB},
zw AS (SELECT video, cut, time, score, depth AS depth_climb,
  coalesce(greatest(0, score - min(score) OVER ({NEAR_CUT} 3 PRECEDING AND 1 PRECEDING)), 0) + coalesce(greatest(0, score - min(score) OVER ({NEAR_CUT} 1 FOLLOWING AND 3 FOLLOWING)), 0) AS depth_window,
  score - median(score) OVER ({NEAR_CUT} 5 PRECEDING AND 5 FOLLOWING) AS score_rel FROM z),
w2 AS {_other_width_sql(2, 1)},
w10 AS {_other_width_sql(10, P.coherence_topk)},
aj AS (SELECT a.video, a.shot AS cut, greatest(0, least(1, ({CLIP} + 1) / 2)) AS adj_clip, {COLOR} AS adj_color FROM s a
  JOIN s b ON a.video = b.video AND b.shot = a.shot + 1),
k AS (SELECT p.*, unnest(range(i - 4, j + 4)) AS cut FROM p WHERE j - i < 8),
bl AS (SELECT video, cut, avg(sim) FILTER (i <= cut AND j > cut) AS cross_mean, avg(sim) FILTER (j <= cut) AS left_coherence, avg(sim) FILTER (i > cut) AS right_coherence
  FROM k WHERE i >= cut - 3 AND j <= cut + 4 GROUP BY video, cut),
fr AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame, value / 100 AS prob FROM events),
tr AS (SELECT video, frame, max(prob) OVER q AS peak, CAST(count(*) FILTER (prob > 0.5) OVER q > 2 AS DOUBLE) AS gradual
  FROM fr WINDOW q AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
pc AS (SELECT a.video, a.cut, count(*) AS pace FROM zw a JOIN zw b ON a.video = b.video AND abs(a.time - b.time) < 15 GROUP BY a.video, a.cut)
SELECT video, cut, time, round(zw.score, 6) AS score, round(depth_climb, 6) AS depth_climb, round(depth_window, 6) AS depth_window, round(score_rel, 6) AS score_rel,
  round(w2.score, 6) AS score_w2, round(w10.score, 6) AS score_w10, round(adj_clip, 6) AS adj_clip, round(adj_color, 6) AS adj_color,
  round(coalesce(cross_mean, 0), 6) AS cross_mean, round(coalesce(left_coherence, 1), 6) AS left_coherence, round(coalesce(right_coherence, 1), 6) AS right_coherence,
  round(ln(5.0::DOUBLE), 6) AS log_dur_prev, round(ln(5.0::DOUBLE), 6) AS log_dur_next, CAST(pace AS DOUBLE) AS pace, round(coalesce(peak, 0), 6) AS trans_peak, coalesce(gradual, 0) AS trans_gradual
FROM zw JOIN w2 USING (video, cut) JOIN w10 USING (video, cut) JOIN aj USING (video, cut) JOIN pc USING (video, cut)
LEFT JOIN bl USING (video, cut) LEFT JOIN tr ON tr.video = zw.video AND tr.frame = zw.cut + 1"""


def _features(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("video", "frame", (F.col("prob") / 100).alias("prob"))
    return learn.boundary_features(embedding_shots(spark, sf_dir), P, frames, fps=1 / SHOT_SECONDS)


@query(FEATURES_SQL.replace("SELECT video, cut, time, round(zw.score", "SELECT zw.video, zw.cut, time, round(zw.score"))
def boundary_features_16(spark, sf_dir):
    return _features(spark, sf_dir).withColumns({c: F.round(c, 6) for c in learn.FEATURES})


@query(f"""WITH {pairs_sql()}{CLIMB} SELECT video, cut, round(1 / (1 + exp(-(-0.4 + 1.7 * (score - 0.4) / 0.05 + 0.9 * (depth - 0.1) / 0.08))), 6) AS p FROM z""")
def model_scores(spark, sf_dir):
    """A stored linear model over two features."""
    shots = embedding_shots(spark, sf_dir)
    cuts = coherence.depth_climb(coherence.coherence(coherence.pair_similarities(shots, P), shots, P))
    return cuts.select("video", "cut", F.round(learn.linear_score(["score", "depth"], [0.4, 0.1], [0.05, 0.08], [1.7, 0.9], -0.4), 6).alias("p"))


PROB = pairs_sql() + CLIMB + ", mp AS (SELECT video, cut, time, 1 / (1 + exp(-(1.7 * (score - 0.4) / 0.05))) AS p FROM z)"


@query(f"""WITH RECURSIVE {PROB}{fold_sql('mp', 'p', 'p >= 0.5', 10.0)}
SELECT mp.video, cut, CASE WHEN list_contains(coalesce(chosen, []), time) THEN 'boundary' WHEN p >= 0.5 THEN 'min_duration' ELSE 'below_abs' END AS decision
  FROM mp LEFT JOIN h USING (video)""")
def model_boundaries(spark, sf_dir):
    """Boundaries by a model's probability instead of the rule."""
    shots = embedding_shots(spark, sf_dir)
    cuts = coherence.coherence(coherence.pair_similarities(shots, P), shots, P).join(scenes.durations(shots), "video")
    cuts = cuts.withColumn("p", learn.linear_score(["score"], [0.4], [0.05], [1.7], 0.0))
    rows = cuts.join(learn.by_probability(cuts, 0.5, 10.0), "video", "left")
    return rows.select("video", "cut", learn.model_decision(F.col("p"), 0.5, F.coalesce(F.array_contains("chosen", F.col("time")), F.lit(False))).alias("decision"))


def _examples(spark, sf_dir):
    return materialised(learn.boundary_labels(_features(spark, sf_dir), _truth(spark, sf_dir)), "examples")


# Cuts are 4 s apart and labels lie on cuts, so within 2 s only the label's own cut stands for it.
@query(f"""WITH {EMB}{TRUTH.split(chr(10) + 'bd AS')[0].rstrip(',')}
SELECT d.video, n - 1 AS cuts, count(tr.time) AS positives FROM d LEFT JOIN tr ON tr.video = d.video GROUP BY d.video, n""")
def examples_from_labels(spark, sf_dir):
    return _examples(spark, sf_dir).groupBy("video").agg(F.count(F.lit(1)).alias("cuts"), F.sum("label").alias("positives"))


def _out_of_fold(spark, sf_dir, kind: str):
    """Each video scored by models that learned from all others."""
    return learn.out_of_fold(_examples(spark, sf_dir), kind, ["video", "cut"], experiment.PENALTIES).drop("fold")


@query()
def logistic_boundary(spark, sf_dir):
    """Out-of-fold probabilities of logistic models, of every penalty."""
    return _out_of_fold(spark, sf_dir, "logistic")


@query()
def gbdt_boundary(spark, sf_dir):
    """Out-of-fold probabilities of boosted trees."""
    return _out_of_fold(spark, sf_dir, "gbdt").drop("c")


@query(f"""WITH RECURSIVE {decisions_sql()},
mp AS (SELECT video, cut, time, decision = 'boundary' AS is_rule, 1 / (1 + exp(-(1.7 * (score - 0.4) / 0.05))) AS p FROM b),
kp AS (SELECT video, time, greatest(p, 1e-6) AS strength FROM mp WHERE (is_rule AND p >= 0.45) OR p >= 0.6),
ho AS (SELECT video, time, row_number() OVER (PARTITION BY video ORDER BY strength DESC, time) AS k FROM kp),
hg AS (SELECT video, 0 AS k, [0.0::DOUBLE, duration] AS taken FROM d
  UNION ALL
  SELECT hg.video, ho.k, CASE WHEN list_min(list_transform(hg.taken, lambda x: abs(x - ho.time))) >= {P.min_scene_seconds} THEN list_append(hg.taken, ho.time) ELSE hg.taken END
  FROM hg JOIN ho ON ho.video = hg.video AND ho.k = hg.k + 1),
hh AS (SELECT video, unnest(arg_max(taken, k)[3:]) AS time FROM hg GROUP BY video)
SELECT video, time FROM hh""")
def hybrid_boundaries(spark, sf_dir):
    """The rule's boundaries without those that a stored model is sure against, with those that it is sure of."""
    cuts = materialised(scenes.cut_decisions(embedding_shots(spark, sf_dir), P), "decisions")
    cuts = cuts.withColumn("p", learn.linear_score(["score"], [0.4], [0.05], [1.7], 0.0)).withColumn("is_rule", F.col("decision") == "boundary")
    return learn.hybrid(cuts, 0.45, 0.6, P.min_scene_seconds).select("video", F.explode("chosen").alias("time"))


def _experiment(spark, sf_dir):
    """The rows of an experiment. Every fourth video is a validation video: never learned from, judged by models of the others."""
    rule = scenes.cut_decisions(embedding_shots(spark, sf_dir), P).select("video", "cut", (F.col("decision") == "boundary").alias("is_rule"))
    rows = _examples(spark, sf_dir).join(rule, ["video", "cut"]).join(_videos(spark, sf_dir), "video")
    return materialised(rows.withColumn("is_val", F.col("video") % 4 == 3), "experiment-examples")


@query()
def model_settings(spark, sf_dir):
    """The penalty, threshold and limits of each method that are best on the others, for each development video and for all."""
    scored = experiment.probabilities(_experiment(spark, sf_dir))
    return experiment.chosen_settings(scored, _truth(spark, sf_dir), P.min_scene_seconds)


@query()
def decide_acceptance(spark, sf_dir):
    """The rule, the tuned rule, both learned models and the hybrid, each on videos that it wasn't fitted or tuned on, and
    whether they may replace the rule."""
    tries = tune.tried(embedding_shots(spark, sf_dir), P, GRID)
    figures, _ = experiment.run(_experiment(spark, sf_dir), _truth(spark, sf_dir), _predicted(spark, sf_dir), tries, len(GRID), P.min_scene_seconds)
    return learn.accepted(figures.where("part IN ('dev', 'val')").withColumnRenamed("f1_2s", "f1"), "rule")


GRID = tune.grid(window_shots=[4, 6], abs_threshold=[0.37, 0.39, 0.41], depth_threshold=[0.02, 0.05], min_scene_seconds=[8.0, 12.0])


def _grid_sql() -> str:
    """The F1 of each setting on each video, as ft. Boundaries are 4 s apart, so within 2 s only equal ones match."""
    rows = ", ".join(f"({n}, {g['window_shots']}, {g['abs_threshold']}, {g['depth_threshold']}, {g['min_scene_seconds']}::DOUBLE)" for n, g in enumerate(GRID))
    scored = " UNION ALL ".join(f"SELECT {w} AS w, * FROM (WITH {pairs_sql(w)}{CLIMB} SELECT video, time, score, depth FROM z)" for w in (4, 6))
    return f"""WITH RECURSIVE {EMB}{TRUTH.split(chr(10) + 'bd AS')[0].rstrip(',')},
st AS (SELECT * FROM (VALUES {rows}) v(setting, w, low, deep, least)),
zz AS ({scored}),
cd AS (SELECT setting, video, time, score FROM st JOIN zz USING (w) WHERE score >= low AND (score >= {P.strong_threshold} OR depth >= deep)),
oo AS (SELECT *, row_number() OVER (PARTITION BY setting, video ORDER BY score DESC, time) AS k FROM cd),
gg AS (SELECT setting, video, least, 0 AS k, [0.0::DOUBLE, duration] AS taken FROM st, d
  UNION ALL SELECT gg.setting, gg.video, gg.least, oo.k,
    CASE WHEN list_min(list_transform(gg.taken, lambda x: abs(x - oo.time))) >= gg.least THEN list_append(gg.taken, oo.time) ELSE gg.taken END
  FROM gg JOIN oo ON oo.setting = gg.setting AND oo.video = gg.video AND oo.k = gg.k + 1),
fin AS (SELECT setting, video, arg_max(taken, k)[3:] AS said FROM gg GROUP BY setting, video),
tt AS (SELECT d.video, list(tr.time) FILTER (tr.time IS NOT NULL) AS held FROM d LEFT JOIN tr ON tr.video = d.video GROUP BY d.video),
nn AS (SELECT setting, video, len(said) AS n_pred, coalesce(len(held), 0) AS n_true, coalesce(len(list_intersect(said, held)), 0) AS tp FROM fin JOIN tt USING (video)),
ft AS (SELECT setting, video, CASE WHEN n_pred + n_true = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END AS f1 FROM nn)"""


#: The whole search: 4 x 3 x 5 x 5 x 3 x 3 x 3 settings.
SEARCH = tune.grid(
    window_shots=[2, 4, 6, 8], coherence_topk=[1, 2, 3], abs_threshold=[0.3, 0.4, 0.45, 0.5, 0.6], depth_threshold=[0.1, 0.2, 0.3, 0.4, 0.5],
    strong_threshold=[0.65, 0.75, 1.01], min_scene_seconds=[4.0, 6.0, 10.0], clip_weight=[1.0, 0.75, 0.5],
)


@query()
def tuning_search(spark, sf_dir):
    """The best of 8,100 settings, what it and the default reach, and what settings chosen on the other videos reach."""
    return tune.report(embedding_shots(spark, sf_dir), _truth(spark, sf_dir), P, SEARCH)


def _figures(spark, sf_dir):
    return materialised(tune.judged(embedding_shots(spark, sf_dir), _truth(spark, sf_dir), P, GRID), "tuning")


@query(_grid_sql() + """, mf AS (SELECT setting, avg(f1) AS m FROM ft GROUP BY setting)
SELECT CAST(setting AS BIGINT) AS setting, round(m, 6) AS macro_f1, row_number() OVER (ORDER BY round(m, 12) DESC, setting) AS place FROM mf""")
def tuning_grid(spark, sf_dir):
    return tune.tuned(_figures(spark, sf_dir)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(_grid_sql() + """, tl AS (SELECT setting, sum(f1) AS total, count(*) AS n FROM ft GROUP BY setting),
rs AS (SELECT video, setting, f1, round((total - f1) / (n - 1), 12) AS rest FROM ft JOIN tl USING (setting) WHERE n >= 3)
SELECT video, CAST(setting AS BIGINT) AS setting, round(f1, 6) AS f1
  FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY rest DESC, setting) AS k FROM rs) WHERE k = 1""")
def tuning_leave_one_out(spark, sf_dir):
    """For each video the setting that is best on the others, judged on it."""
    return tune.leave_one_out(_figures(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query("""WITH p AS (SELECT unnest(range(0, 40)) AS setting), v AS (SELECT setting, round(avg(CASE WHEN value > setting * 3 THEN 1.0::DOUBLE ELSE 0 END) * (1 - setting / 40.0::DOUBLE), 9) AS value
  FROM p, events GROUP BY setting)
SELECT setting, round(value, 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, setting) AS k FROM v) WHERE k = 1""")
def grid_argmax(spark, sf_dir):
    """The first best of a grid of thresholds, all judged in one pass over the data."""
    from ..sources.adapters import table

    columns = [F.avg((F.col("value") > 3 * s).cast("double")).alias(f"s{s}") for s in range(40)]
    one = table(spark, sf_dir, "events").agg(*columns)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("setting"), F.round(F.col(f"s{s}") * (1 - s / 40.0), 9).alias("value")) for s in range(40)])))
    return rows.agg(F.max_by(F.struct("setting", "value"), F.struct("value", -F.col("setting"))).alias("b")).select("b.setting", F.round("b.value", 6).alias("value"))
