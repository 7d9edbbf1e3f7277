"""Streams over folders of files in any order against their batch forms."""

from __future__ import annotations

import random
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from shotweave.operators import labels
from shotweave.plans.streams import _with_rocks
from shotweave.streaming import corrections, segmenter


def plain_cuts(rows, watermark, threshold, least, step, idle):
    """Cuts of frames (video, frame, prob) that end before the watermark."""
    out = []
    for video in {v for v, *_ in rows}:
        mine = {}
        for v, f, p in rows:
            if v == video:
                mine[f] = max(p, mine.get(f, p))
        kept, run, latest = 0, [], max(mine)
        done = sorted(f for f in mine if (f + 1) * step <= watermark)
        for f in [*done, None]:
            ended = f is not None and mine[f] <= threshold or f is None and done and done[-1] == latest and (latest + 1) * step + idle <= watermark
            if f is not None and mine[f] > threshold:
                run.append(f)
            elif ended and run:
                cut = (run[0] + run[-1] + 2) // 2
                if cut - kept >= least:
                    kept = cut
                    out.append((video, cut))
                run = []
    return sorted(out)


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_shuffled_files_give_the_cuts_of_a_batch(spark, tmp_path, at_once):
    rng = random.Random(at_once)
    rows = [(v, f, rng.choice([0.1, 0.9, 0.9])) for v in range(6) for f in range(1, 60 if v else 20) if rng.random() < 0.8]
    rows += [(1, f, 0.95) for f in range(40, 44)]  # frames with several rows
    rng.shuffle(rows)
    first = 1_700_000_000
    for k in range(7):  # any file may have any frame
        part = [(v, f, p, first + f + rng.random() * 0.9) for v, f, p in rows[k::7]]
        df = spark.createDataFrame(part, "video long, frame long, prob double, s double")
        df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s").coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
    files = str(tmp_path / "part-*")
    latest = spark.read.parquet(files).agg((F.unix_micros(F.max("ts")) / 1000).cast("long")).first()[0]
    # Frames are seconds since the first, so their ends are that far on.
    stream = spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", at_once).parquet(files).withColumn("frame", F.col("frame") + first)
    with _with_rocks(spark):
        told = segmenter.streamed_cuts(stream, 0.5, 2, 1000, "70 seconds" if at_once < 1000 else "5 seconds", 20_000)
        segmenter.run_to_end(told, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r.video, r.cut) for r in spark.read.schema("video long, cut long").parquet(str(tmp_path / "out")).collect())
    watermark = latest - (70_000 if at_once < 1000 else 5_000)
    assert got == plain_cuts([(v, f + first, p) for v, f, p in rows], watermark, 0.5, 2, 1000, 20_000)
    assert got or at_once < 1000


def test_runs_end_with_their_video(spark, tmp_path):
    rows = [(1, 10, 0.1), (1, 11, 0.9), (1, 12, 0.9), (2, 300, 0.1), (2, 301, 0.9)]
    spark.createDataFrame([(v, f, p, f) for v, f, p in rows], "video long, frame long, prob double, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video long, frame long, prob double, s long, ts timestamp").parquet(str(tmp_path / "in"))
    with _with_rocks(spark):
        segmenter.run_to_end(segmenter.streamed_cuts(stream, 0.5, 2, 1000, "0 seconds", 60_000), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [tuple(r) for r in spark.read.schema("video long, cut long").parquet(str(tmp_path / "out")).collect()]
    assert got == [(1, 12)]  # the run of 2 may go on


def test_videos_share_calls_and_states(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(v, f, rng.choice([0.1, 0.9])) for v in range(300) for f in range(1, 12)]
    calls, plain = spark.sparkContext.accumulator(0), segmenter.kept_cuts

    def counted(*numbers):
        step_of = plain(*numbers)

        def run(key, frames, state):
            calls.add(1)
            return step_of(key, frames, state)

        return run

    monkeypatch.setattr(segmenter, "kept_cuts", counted)
    spark.createDataFrame([*[(v, f, p, f) for v, f, p in rows], (None, 5, 0.9, 5)], "video long, frame long, prob double, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video long, frame long, prob double, s long, ts timestamp").parquet(str(tmp_path / "in"))
    with _with_rocks(spark):
        segmenter.run_to_end(segmenter.streamed_cuts(stream, 0.5, 2, 1000, "3 seconds", 1000, groups=5), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(tuple(r) for r in spark.read.schema("video long, cut long").parquet(str(tmp_path / "out")).collect())
    assert got == plain_cuts(rows, 8000, 0.5, 2, 1000, 1000) and got
    assert 5 <= calls.value <= 10  # a batch of rows and one of timeouts, not a call for each video


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_log_in_parts_leaves_what_the_whole_log_does(spark, tmp_path, shuffled):
    rng = random.Random(3)
    ops = [(v, n, rng.choice(["merge", "split", "split", "confirm", "clear", "reset"] if rng.random() < 0.15 else ["merge", "split", "split"]), rng.randrange(5), round(rng.random() * 90, 2)) for v in range(5) for n in range(24)]
    parts = sorted(ops, key=lambda o: rng.random()) if shuffled else sorted(ops, key=lambda o: o[1])
    full = lambda rows: spark.createDataFrame(rows, "video long, seq long, op string, scene_index int, at double").withColumns({"predicted": F.array(F.lit(30.0), F.lit(10.0)), "duration": F.lit(80.0)})
    for k in range(4):
        full(parts[k * 30 : k * 30 + 30]).coalesce(1).write.parquet(str(tmp_path / f"log-{k}"))
    cuts = spark.createDataFrame([(v, float(t)) for v in range(4) for t in range(5, 80, 7)], "video long, time double")
    stream = spark.readStream.schema(full(ops[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log-*"))
    with _with_rocks(spark):
        segmenter.run_to_end(corrections.streamed_replay(stream, cuts), str(tmp_path / "out"), str(tmp_path / "check"))
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert versions.select("n").distinct().count() > 1
    key = lambda r: (r.video, list(r.boundaries), list(r.hard_negatives), list(r.hard_positives), r.refused)
    assert sorted(map(key, corrections.latest(versions).collect())) == sorted(map(key, labels.replayed(full(ops), cuts).collect()))


def test_a_killed_run_infers_no_hash_twice(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for k in range(4):
        spark.createDataFrame([(f"h{h}", h) for h in range(k * 5, k * 5 + 10)] * 2, "frame_hash string, x long").coalesce(1).write.parquet(f"{source}/part-{k}")
    seen = spark.sparkContext.accumulator(0)

    def infer(new):
        def model(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return new.mapInArrow(model, new.schema)

    stream = lambda: spark.readStream.schema("frame_hash string, x long").option("maxFilesPerTrigger", 1).parquet(f"{source}/part-*")
    killed = []

    def dies(rows, batch):  # killed after a part is written, and before the stream knows; and while another one is
        segmenter.infer_into(rows, batch, store, infer)
        if batch == 1 and not killed:
            killed.append(batch)
            raise RuntimeError("killed")

    writer = stream().writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    with pytest.raises(Exception, match="killed"):
        writer.start().awaitTermination()
    spark.range(3).selectExpr("'half' AS frame_hash", "id AS x").write.parquet(f"{store}/batch=2")
    (tmp_path / "store" / "batch=2" / "_SUCCESS").unlink()
    segmenter.infer_to_end(stream(), store, str(tmp_path / "check"), infer)
    rows = segmenter.inferred(spark, store).collect()
    assert sorted(r.frame_hash for r in rows) == sorted(f"h{h}" for h in range(25)) and seen.value == 25
    segmenter.infer_to_end(stream(), store, str(tmp_path / "check"), infer)
    assert seen.value == 25


def test_rocks_setting_is_given_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with _with_rocks(spark), nullcontext():
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before
