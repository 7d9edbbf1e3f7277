"""Queries over frames and cuts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeline
from ..params import Shots
from ..sources.adapters import EVENT_THRESHOLD, event_frames, event_videos
from .registry import query

LEAST = timeline.min_frames(Shots().min_shot_seconds, 25.0)

FRAMES = """f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame, value AS prob,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS seconds, event_type FROM events),
n AS (SELECT video, count(*) AS n_frames, 25.0 AS fps, count(*) / 25.0 + 0.02 AS duration FROM f GROUP BY video)"""
CUTS = FRAMES + f""",
r AS (SELECT video, min(frame) AS first, max(frame) AS last, max(prob) AS peak FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS island FROM f WHERE prob > {EVENT_THRESHOLD}) GROUP BY video, island),
c AS (SELECT video, (first + last + 2) // 2 AS cut, peak, n_frames FROM r JOIN n USING (video) WHERE (first + last + 2) // 2 BETWEEN 1 AND n_frames - 1)"""
KEPT = CUTS + f""",
o AS (SELECT video, n_frames, cut, row_number() OVER (PARTITION BY video ORDER BY cut) AS k FROM (SELECT DISTINCT video, n_frames, cut FROM c)),
g AS (SELECT video, n_frames, 0 AS k, 0 AS last, 0 AS kept FROM (SELECT DISTINCT video, n_frames FROM o)
  UNION ALL SELECT g.video, g.n_frames, o.k, CASE WHEN o.cut - g.last >= {LEAST} THEN o.cut ELSE g.last END, CASE WHEN o.cut - g.last >= {LEAST} THEN 1 ELSE 0 END
  FROM g JOIN o ON o.video = g.video AND o.k = g.k + 1),
m AS (SELECT video, last AS cut FROM g WHERE kept = 1 AND n_frames - last >= {LEAST})"""
SHOTS = KEPT + """,
e AS (SELECT video, cut AS b FROM m UNION SELECT video, 0 FROM n),
h AS (SELECT e.video, row_number() OVER (PARTITION BY e.video ORDER BY b) - 1 AS shot, b AS start_frame, coalesce(lead(b) OVER (PARTITION BY e.video ORDER BY b), n_frames) AS end_frame, fps, duration, n_frames
  FROM e JOIN n USING (video)),
s AS (SELECT video, shot, start_frame, end_frame, round(start_frame / fps, 3) AS start, round(CASE WHEN end_frame = n_frames THEN duration ELSE end_frame / fps END, 3) AS "end"
  FROM h)"""


def _cuts(spark, sf_dir):
    return timeline.cuts(event_frames(spark, sf_dir), EVENT_THRESHOLD)


def _kept(spark, sf_dir):
    return timeline.merge_short(_cuts(spark, sf_dir), LEAST)


def _shots(spark, sf_dir):
    return timeline.shots_from_cuts(_kept(spark, sf_dir), event_videos(event_frames(spark, sf_dir)))


@query(f"WITH {CUTS} SELECT video, first, last, peak FROM r")
def frame_threshold_runs(spark, sf_dir):
    return timeline.islands(event_frames(spark, sf_dir), F.col("prob") > EVENT_THRESHOLD)


@query(f"WITH {CUTS} SELECT DISTINCT video, cut, n_frames FROM c")
def interior_cuts(spark, sf_dir):
    return timeline.interior(_cuts(spark, sf_dir))


@query(f"WITH RECURSIVE {KEPT} SELECT video, cut FROM m")
def merge_short_shots(spark, sf_dir):
    return _kept(spark, sf_dir)


@query(f"WITH RECURSIVE {SHOTS} SELECT * FROM s")
def shots_from_cuts(spark, sf_dir):
    return _shots(spark, sf_dir)


@query(f"WITH RECURSIVE {SHOTS} SELECT * FROM s")
def staged_shots(spark, sf_dir):
    """The same shots by stages that are kept: signals, cuts, shots, each found again where nothing before it changed."""
    from ..sources.stages import StageStore
    from ..sources.tables import shared_folder

    store = StageStore(spark, f"{shared_folder(spark)}/stages")
    events = store.source(f"{sf_dir}/events.parquet")
    frames = store.stage("frames", lambda _: event_frames(spark, sf_dir), [events])
    cuts = store.stage("cuts", lambda f: timeline.cuts(f, EVENT_THRESHOLD), [frames], {"threshold": EVENT_THRESHOLD})
    shots = store.stage("shots", lambda f, c: timeline.shots_from_cuts(timeline.merge_short(c, LEAST), event_videos(f)), [frames, cuts], {"least": LEAST})
    return shots.rows


@query(f"""WITH RECURSIVE {SHOTS}
  SELECT video, shot, p.pos, CAST(least(start_frame + floor(p.p * greatest(1, end_frame - start_frame)), end_frame - 1) AS BIGINT) AS frame
FROM s, (VALUES (0, 0.15::DOUBLE), (1, 0.5::DOUBLE), (2, 0.85::DOUBLE)) AS p(pos, p)""")
def sample_frames(spark, sf_dir):
    return timeline.sampled_frames(_shots(spark, sf_dir), Shots().frame_positions)


@query(f"""WITH RECURSIVE {SHOTS}, x AS (SELECT video, shot, pos, CAST(least(start_frame + floor(p * greatest(1, end_frame - start_frame)), end_frame - 1) AS BIGINT) AS frame
FROM s, (VALUES (0, 0.15::DOUBLE), (1, 0.5::DOUBLE), (2, 0.85::DOUBLE)) AS p(pos, p)) SELECT video, shot, pos, frame, prob FROM x JOIN f USING (video, frame)""")
def shot_slots(spark, sf_dir):
    """Frames that are read, handed to every shot and position that asked for them."""
    slots = timeline.sampled_frames(_shots(spark, sf_dir), Shots().frame_positions)
    return slots.join(event_frames(spark, sf_dir).select("video", "frame", "prob"), ["video", "frame"])


def _minutes(spark, sf_dir):
    """Segments of 1 s over the videos of shots, to put shots in."""
    videos = event_videos(event_frames(spark, sf_dir))
    edges = videos.select("video", "duration", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor("duration")))).alias("at")).select("video", F.col("at").cast("double").alias("at"))
    return timeline.segments(edges, "at", videos, "duration", 0.0)


@query(f"""WITH RECURSIVE {SHOTS}, t AS (SELECT video, unnest(range(0, CAST(floor(duration) AS BIGINT) + 1)) AS b, duration FROM n)
SELECT video, shot, max(b) AS segment FROM s JOIN t USING (video) WHERE start >= b - 1e-3 AND b < duration GROUP BY video, shot""")
def shot_containment(spark, sf_dir):
    return timeline.containment(_shots(spark, sf_dir), _minutes(spark, sf_dir))


SECONDS = FRAMES + f""",
q AS (SELECT video, seconds, prob FROM f WHERE prob > {EVENT_THRESHOLD}), a AS (SELECT video, frame, seconds, event_type FROM f WHERE event_type = 'error')"""


@query(f"""WITH {SECONDS} SELECT a.video, a.frame, round(arg_min(q.seconds, abs(q.seconds - a.seconds) * 1e6 + q.seconds / 1e9), 6) AS nearest
FROM a LEFT JOIN q ON q.video = a.video AND q.seconds BETWEEN a.seconds - 50000 AND a.seconds + 50000 GROUP BY a.video, a.frame""")
def nearest_cut(spark, sf_dir):
    """The transition nearest to each error event within 50,000 s."""
    frames = event_frames(spark, sf_dir)
    found = timeline.nearest(frames.where("event_type = 'error'").select("video", "frame", "seconds"), "seconds", frames.where(F.col("prob") > EVENT_THRESHOLD), "seconds", 50_000.0, 50_000.0)
    return found.select("video", "frame", F.round("nearest", 6).alias("nearest"))


@query(f"""WITH {SECONDS} SELECT a.video, a.frame, round(coalesce(arg_min(q.seconds, abs(q.seconds - a.seconds)), a.seconds), 3) AS at
FROM a LEFT JOIN q ON q.video = a.video AND q.seconds BETWEEN a.seconds - 20000 AND a.seconds + 5000 GROUP BY a.video, a.frame, a.seconds""")
def snap_split(spark, sf_dir):
    """A split point moves to the nearest transition in an asymmetric window; without one it stays."""
    frames = event_frames(spark, sf_dir)
    found = timeline.nearest(frames.where("event_type = 'error'").select("video", "frame", "seconds"), "seconds", frames.where(F.col("prob") > EVENT_THRESHOLD), "seconds", 20_000.0, 5_000.0)
    return found.select("video", "frame", F.round(F.coalesce("nearest", "seconds"), 3).alias("at"))


@query(f"""WITH {FRAMES} SELECT a.video, a.frame, count(b.frame) AS pace FROM f a
  JOIN f b ON a.video = b.video AND b.seconds > a.seconds - 60000 AND b.seconds < a.seconds + 60000 GROUP BY a.video, a.frame""")
def pace_15s(spark, sf_dir):
    """Events strictly within a time on both sides: a range frame without its exact ends."""
    micros = F.round(F.col("seconds") * 1e6).cast("long")
    w = Window.partitionBy("video").orderBy("micros").rangeBetween(-60_000_000_000 + 1, 60_000_000_000 - 1)
    return event_frames(spark, sf_dir).withColumn("micros", micros).select("video", "frame", F.count(F.lit(1)).over(w).alias("pace"))


@query(f"""WITH {CUTS} SELECT c.video, c.cut, max(f.prob) AS peak, CAST(count(*) FILTER (f.prob > 50) > 2 AS INTEGER) AS gradual, count(*) AS n
FROM c JOIN f ON f.video = c.video AND f.frame BETWEEN c.cut - 12 AND c.cut + 11 GROUP BY c.video, c.cut""")
def transition_window(spark, sf_dir):
    """The signal from 12 frames before a cut to 11 after: its peak, and whether it stays up."""
    w = Window.partitionBy("video").orderBy("frame").rowsBetween(-12, 11)
    frames = event_frames(spark, sf_dir)
    around = frames.select("video", F.col("frame").alias("cut"), F.max("prob").over(w).alias("peak"), (F.count_if(F.col("prob") > 50).over(w) > 2).cast("int").alias("gradual"), F.count(F.lit(1)).over(w).alias("n"))
    return around.join(_cuts(spark, sf_dir).select("video", "cut"), ["video", "cut"])


@query(f"""WITH {CUTS}, w AS (SELECT c.video, c.cut, max(f.prob) AS peak, count(*) FILTER (f.prob > 50) AS high FROM c
  JOIN f ON f.video = c.video AND f.frame BETWEEN c.cut - 12 AND c.cut + 11 GROUP BY c.video, c.cut)
SELECT video, cut, CASE WHEN peak IS NULL THEN 'unknown' WHEN peak < 60 THEN 'none' WHEN peak < 90 THEN 'weak' WHEN high > 2 THEN 'gradual' ELSE 'hard' END AS kind
  FROM w""")
def transition_kind(spark, sf_dir):
    w = Window.partitionBy("video").orderBy("frame").rowsBetween(-12, 11)
    around = event_frames(spark, sf_dir).select("video", F.col("frame").alias("cut"), F.max("prob").over(w).alias("peak"), F.count_if(F.col("prob") > 50).over(w).alias("high"))
    kind = F.when(F.col("peak").isNull(), "unknown").when(F.col("peak") < 60, "none").when(F.col("peak") < 90, "weak").when(F.col("high") > 2, "gradual").otherwise("hard")
    return around.join(_cuts(spark, sf_dir).select("video", "cut"), ["video", "cut"]).select("video", "cut", kind.alias("kind"))


@query(f"""WITH {FRAMES}, v AS (SELECT video, frame AS shot, CASE WHEN event_type <> 'error' THEN prob END AS x FROM f),
k AS (SELECT video, shot, CASE WHEN shot = 0 AND x IS NULL THEN lead(x) OVER (PARTITION BY video ORDER BY shot) ELSE x END AS x FROM v)
SELECT video, shot, last_value(x IGNORE NULLS) OVER (PARTITION BY video ORDER BY shot) AS x FROM k""")
def missing_fill(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("video", F.col("frame").alias("shot"), F.when(F.col("event_type") != "error", F.col("prob")).alias("x"))
    return timeline.filled(frames, "x")


@query(f"WITH {FRAMES} SELECT video, frame, round(sum(prob) OVER (PARTITION BY video ORDER BY frame), 4) AS boundary FROM f")
def running_boundaries(spark, sf_dir):
    w = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return event_frames(spark, sf_dir).select("video", "frame", F.round(F.sum("prob").over(w), 4).alias("boundary"))


@query(f"""WITH RECURSIVE {SHOTS}
  SELECT video, shot AS cut, round(ln(1 + "end" - start), 6) AS log_dur_prev, round(lead(ln(1 + "end" - start)) OVER (PARTITION BY video ORDER BY shot), 6) AS log_dur_next
  FROM s""")
def duration_logs(spark, sf_dir):
    d = F.log1p(F.col("end") - F.col("start"))
    w = Window.partitionBy("video").orderBy("shot")
    return _shots(spark, sf_dir).select("video", F.col("shot").alias("cut"), F.round(d, 6).alias("log_dur_prev"), F.round(F.lead(d).over(w), 6).alias("log_dur_next"))


@query(f"""WITH {FRAMES}, k AS (SELECT video, event_type, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY video) AS share FROM f
  GROUP BY video, event_type)
SELECT video, CASE WHEN arg_max(share, c * 1000 - length(event_type)) >= 0 AND max(share) >= 0.3 THEN (list(event_type ORDER BY c DESC, event_type))[1] END AS dominant, round(max(share), 6) AS share
  FROM k GROUP BY video""")
def dominant_value(spark, sf_dir):
    """The commonest value of each video if its share is large enough; the first in the alphabet on ties."""
    counts = event_frames(spark, sf_dir).groupBy("video", "event_type").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("video").agg(F.min(F.struct((-F.col("c")).alias("c"), "event_type")).alias("best"), F.sum("c").alias("n"))
    share = -F.col("best.c") / F.col("n")
    return best.select("video", F.when(share >= 0.3, F.col("best.event_type")).alias("dominant"), F.round(share, 6).alias("share"))


@query(f"""WITH {FRAMES}, b AS (SELECT video, list(DISTINCT CAST(frame AS DOUBLE) ORDER BY CAST(frame AS DOUBLE)) FILTER (prob > {EVENT_THRESHOLD}) AS b, count(*) AS duration, max(frame) FILTER (prob > {EVENT_THRESHOLD}) AS top, min(frame) FILTER (prob > {EVENT_THRESHOLD}) AS low
  FROM f GROUP BY video)
SELECT video, CASE WHEN b IS NULL THEN 'empty' WHEN low <= 0 THEN 'not positive' WHEN top >= duration - 1 THEN 'past the end' WHEN len(b) > 12 THEN 'too many' END AS error
  FROM b""")
def label_validation(spark, sf_dir):
    """Lists of boundaries by five rules; null where a list keeps them all."""
    from ..operators.labels import label_error

    rows = event_frames(spark, sf_dir).groupBy("video").agg(F.sort_array(F.collect_list(F.when(F.col("prob") > EVENT_THRESHOLD, F.col("frame").cast("double")))).alias("b"), (F.count(F.lit(1)) - 1).cast("double").alias("duration"))
    return rows.select("video", label_error(F.col("b"), F.col("duration"), most=12).alias("error"))


@query(f"""WITH {CUTS} SELECT 'cut' AS kind, video, cut AS frame FROM c UNION ALL SELECT 'error', video, frame FROM f WHERE event_type = 'error'""")
def union_errors(spark, sf_dir):
    cuts = _cuts(spark, sf_dir).select(F.lit("cut").alias("kind"), "video", F.col("cut").alias("frame"))
    return cuts.unionByName(event_frames(spark, sf_dir).where("event_type = 'error'").select(F.lit("error").alias("kind"), "video", "frame"))


@query(f"""WITH {CUTS}, e AS (SELECT video, cut FROM (SELECT video, cut, peak, row_number() OVER (PARTITION BY video ORDER BY peak DESC, cut) AS k FROM c)
  WHERE k > 1) SELECT * FROM e""")
def minus_ids(spark, sf_dir):
    """Every cut of a video but its representative, the strongest."""
    rows = _cuts(spark, sf_dir).groupBy("video").agg(F.sort_array(F.collect_list("cut")).alias("all"), F.max_by("cut", F.struct("peak", -F.col("cut"))).alias("best"))
    return rows.select("video", F.explode(F.array_except("all", F.array("best"))).alias("cut"))


@query(f"""WITH {CUTS}, e AS (SELECT f.video, f.frame AS "at", min(abs(c.cut - f.frame)) AS off FROM f LEFT
  JOIN c ON c.video = f.video AND abs(c.cut - f.frame) <= 5 WHERE event_type = 'error' GROUP BY f.video, f.frame)
SELECT video, "at", CASE WHEN off IS NULL THEN 'no cut' WHEN off = 0 THEN 'on the cut' ELSE 'near a cut' END AS diagnosis, row_number() OVER (PARTITION BY video ORDER BY "at") AS place
  FROM e""")
def error_diagnosis(spark, sf_dir):
    """What lies around each error, in order of time."""
    from ..operators.diagnose import error_rows

    frames = event_frames(spark, sf_dir)
    return error_rows(frames.where("event_type = 'error'").select("video", F.col("frame").alias("at")), _cuts(spark, sf_dir).select("video", "cut"), 5)


@query("""SELECT event_id, printf('S%02d-U%02d', user_id, event_id % 100) AS unit, printf('shot_%04d_p%03d.jpg', user_id, event_id % 1000) AS file,
upper(event_type[1]) || lower(event_type[2:]) AS label, printf('%02d:%05.2f', CAST(floor(value / 60) AS INTEGER), value - 60 * floor(value / 60)) AS clock FROM events""")
def format_ids(spark, sf_dir):
    from ..sources.adapters import table

    return table(spark, sf_dir, "events").select(
        "event_id", F.format_string("S%02d-U%02d", "user_id", F.pmod("event_id", F.lit(100))).alias("unit"), F.format_string("shot_%04d_p%03d.jpg", "user_id", F.pmod("event_id", F.lit(1000))).alias("file"),
        F.concat(F.upper(F.substring("event_type", 1, 1)), F.lower(F.substr("event_type", F.lit(2)))).alias("label"),
        F.format_string("%02d:%05.2f", F.floor(F.col("value") / 60), F.col("value") - 60 * F.floor(F.col("value") / 60)).alias("clock"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS doc FROM events")
def json_roundtrip(spark, sf_dir):
    from ..sources.adapters import table

    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("doc"))


@query("SELECT event_id, round(value, 1) AS rounded, round_even(value, 1) AS rounded_even, CAST(trunc(value) AS BIGINT) AS whole, least(greatest(value, 10), 90) AS clipped FROM events")
def round_trim(spark, sf_dir):
    from ..sources.adapters import table

    return table(spark, sf_dir, "events").select("event_id", F.round("value", 1).alias("rounded"), F.bround("value", 1).alias("rounded_even"), F.col("value").cast("long").alias("whole"), F.least(F.greatest("value", F.lit(10.0)), F.lit(90.0)).alias("clipped"))


@query(f"WITH {FRAMES} SELECT round(seconds, 6) AS seconds, video, frame FROM f WHERE event_type = 'error' ORDER BY seconds, video")
def error_order(spark, sf_dir):
    """Errors of all videos in order of time."""
    rows = event_frames(spark, sf_dir).where("event_type = 'error'").orderBy("seconds", "video")
    return rows.select(F.round("seconds", 6).alias("seconds"), "video", "frame")


@query(f"""WITH {FRAMES}, a AS (SELECT *, count(*) OVER (PARTITION BY video) AS n_frames, (sum(prob) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - prob) / 4 AS around
  FROM f)
SELECT video, frame AS cut, prob AS peak, n_frames FROM a WHERE frame >= 2 AND frame < n_frames - 2 AND prob / around >= 1.8 AND prob >= 15""")
def adaptive_cuts(spark, sf_dir):
    return timeline.adaptive_cuts(event_frames(spark, sf_dir), 1.8, 15.0)


@query(f"""WITH RECURSIVE {SHOTS}, mg AS (SELECT *, least(1.0 / 25, ("end" - start) / 4) AS margin FROM s)
SELECT video, shot, p.pos, round(least(greatest(start + p.p * ("end" - start), start + margin), "end" - margin), 6) AS seconds
  FROM mg, (VALUES (0, 0.001::DOUBLE), (1, 0.5::DOUBLE), (2, 0.999::DOUBLE)) AS p(pos, p)""")
def frame_times(spark, sf_dir):
    at = F.posexplode(F.array(F.lit(0.001), F.lit(0.5), F.lit(0.999))).alias("pos", "p")
    rows = _shots(spark, sf_dir).select("video", "shot", "start", "end", at)
    return rows.select("video", "shot", F.col("pos").cast("long").alias("pos"), F.round(timeline.frame_time(F.col("start"), F.col("end"), F.col("p"), F.lit(25.0)), 6).alias("seconds"))
