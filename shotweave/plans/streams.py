"""Queries that run as streams over all that the tables hold now, and their batch twins."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import timeline
from ..sources.adapters import EVENT_THRESHOLD, embedding_shots, event_frames, table
from ..sources.tables import shared_folder
from ..streaming import corrections, segmenter
from .datasets import correction_log, correction_replay_sql, replay_rows
from .registry import query
from .timelines import KEPT, LEAST


@contextmanager
def _with_rocks(spark):
    """The state store that list states and timers need, for the streams started here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _finished(spark, stream, schema: str):
    """Run a stream to its end into a table in the shared folder, and read that."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    segmenter.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("""WITH o AS (SELECT user_id AS video, ts, value AS prob, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM events),
k AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY ts) AS session FROM o)
SELECT video, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, max(prob) AS peak FROM k GROUP BY video, session""")
def batch_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("prob"))
    return segmenter.sessions(rows, "6 hours", "1 hour").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query()
def stream_sessions(spark, sf_dir):
    """The same sessions as a stream: those that the watermark has closed."""
    rows = segmenter.read_stream(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("prob"))
    return _finished(spark, segmenter.sessions(rows, "6 hours", "1 hour"), "video long, start timestamp, end timestamp, n long, peak double")


@query(f"""WITH RECURSIVE {KEPT} SELECT video, last AS cut FROM g WHERE kept = 1""")
def batch_segmenter(spark, sf_dir):
    """Cuts as a stream keeps them: it can't know that the last shot will be too short."""
    frames = event_frames(spark, sf_dir)
    cuts = timeline.cuts(frames, EVENT_THRESHOLD)
    return timeline.merge_short(cuts.withColumn("n_frames", F.col("n_frames") + LEAST), LEAST)


FRAME_MS, DELAY_HOURS, IDLE_MS, LEAST_FRAMES = 600_000, 1, 86_400_000, 3
#: Events of a group of videos, about.
GROUP_EVENTS = 20_000


# The same frames as the stream's: those that end before its last watermark; a run ends at a lower frame, or with its video.
@query(f"""WITH RECURSIVE wm AS (SELECT max(epoch_ms(ts)) - {DELAY_HOURS} * 3600000 AS w FROM events),
fr AS (SELECT user_id AS video, epoch_us(ts) // {FRAME_MS * 1000} AS frame, max(value) AS prob FROM events GROUP BY ALL),
jf AS (SELECT video, frame, prob > {EVENT_THRESHOLD} AS up FROM fr, wm WHERE (frame + 1) * {FRAME_MS} <= w),
le AS (SELECT video, max(frame) AS latest FROM fr GROUP BY video),
rn AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) - row_number() OVER (PARTITION BY video, up ORDER BY frame) AS island, lead(frame) OVER (PARTITION BY video ORDER BY frame) AS after FROM jf),
ru AS (SELECT video, min(frame) AS first, max(frame) AS last, bool_or(after IS NULL) AS open FROM rn WHERE up GROUP BY video, island),
cu AS (SELECT video, (first + last + 2) // 2 AS cut FROM ru JOIN le USING (video), wm WHERE NOT open OR (latest = last AND (latest + 1) * {FRAME_MS} + {IDLE_MS} <= w)),
oc AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY cut) AS k FROM cu),
kp AS (SELECT DISTINCT video, 0 AS k, 0::BIGINT AS last, false AS kept FROM oc
  UNION ALL SELECT kp.video, oc.k, CASE WHEN cut - last >= {LEAST_FRAMES} THEN cut ELSE last END, cut - last >= {LEAST_FRAMES} FROM kp JOIN oc ON oc.video = kp.video AND oc.k = kp.k + 1)
SELECT video, last AS cut FROM kp WHERE kept""")
def stream_segmenter(spark, sf_dir):
    """Cuts of a stream of events, in whatever order its files come; a frame is ten minutes."""
    ts = F.col("ts").cast("timestamp")
    rows = segmenter.read_stream(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.floor(F.unix_micros(ts) / (FRAME_MS * 1000)).alias("frame"), F.col("value").alias("prob"), ts.alias("ts"))
    groups = max(64, table(spark, sf_dir, "events").count() // GROUP_EVENTS)
    with _with_rocks(spark):
        return _finished(spark, segmenter.streamed_cuts(rows, EVENT_THRESHOLD, LEAST_FRAMES, FRAME_MS, f"{DELAY_HOURS} hours", IDLE_MS, groups), "video long, cut long")


@query(correction_replay_sql)
def stream_corrections(spark, sf_dir):
    """The replay of :func:`correction_replay` as a stream: each video's state folds what comes in."""
    cuts = embedding_shots(spark, sf_dir).where("shot > 0").select("video", F.col("start").alias("time"))
    log = correction_log(segmenter.read_stream(spark, sf_dir, "conversations"))
    with _with_rocks(spark):
        versions = _finished(spark, corrections.streamed_replay(log, cuts), "video long, n long, boundaries array<double>, hard_negatives array<double>, hard_positives array<double>, refused int")
    return replay_rows(corrections.latest(versions))


@query(f"""SELECT sha1(event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS frame_hash, any_value(CAST(floor(value) AS BIGINT)) AS level, any_value(floor(value) > {EVENT_THRESHOLD}) AS found FROM events GROUP BY 1""")
def incremental_inference(spark, sf_dir):
    """A stream of frames through a model that sees each hash once: a store of what was inferred, batch by batch."""
    level = F.floor("value")
    name = F.sha1(F.concat("event_type", F.lit("/"), level.cast("string"))).alias("frame_hash")
    rows = segmenter.read_stream(spark, sf_dir, "events", at_once=1).select(name, level.alias("level"))
    base = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    segmenter.infer_to_end(rows, f"{base}/store", f"{base}/checkpoint", lambda new: new.withColumn("found", F.col("level") > EVENT_THRESHOLD))
    return segmenter.inferred(spark, f"{base}/store").drop("batch")
