"""Streams of frame signals: runs above a threshold, kept cuts, sessions; and the store that incremental runs consult."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import file_system

#: Of the videos of a group: each one's latest judged frame, open run (-1: none) and last cut that was kept; and the frames that wait for the watermark, with their signals.
STATE = "video array<long>, latest array<long>, run_first array<long>, run_last array<long>, kept array<long>, of array<long>, frame array<long>, prob array<double>"


def kept_cuts(threshold: float, least: int, step: int, idle: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of a group of videos. Per video: frames that wait for the watermark to pass them, and of those before it the latest one, the open run and the last cut that was kept.

    Frames come in any order; each is judged once the watermark has passed its end, so that none before it can still come. A timeout at the end of the group's first waiting frame sees to
    that, also where a video gets no more frames; one that has had none for ``idle`` milliseconds has ended, and so has its open run.
    Of several rows of a frame the highest signal counts."""

    def step_of(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, of, frames, probs = map(list, state.get) if state.exists else [[] for _ in range(8)]
        for batch in rows:
            of += batch["video"].tolist()
            frames += batch["frame"].tolist()
            probs += batch["prob"].tolist()
        waiting: dict[tuple[int, int], float] = {}
        for at, prob in zip(zip(of, frames), probs):
            waiting[at] = max(prob, waiting.get(at, prob))
        videos = {video: numbers for video, *numbers in zip(*known)}
        for video, _ in waiting:
            videos.setdefault(video, [-1, -1, -1, 0])
        watermark, out = state.getCurrentWatermarkMs(), []

        def ended(video: int) -> None:
            latest, first, last, kept = videos[video]
            if first >= 0:
                cut = (first + last + 2) // 2
                if cut > 0 and cut - kept >= least:
                    kept = cut
                    out.append((video, cut))
            videos[video] = [latest, -1, -1, kept]

        for video, frame in sorted(at for at in waiting if (at[1] + 1) * step <= watermark):
            mine = videos[video]
            mine[0] = max(mine[0], frame)
            if waiting.pop((video, frame)) > threshold:
                mine[1:3] = frame if mine[1] < 0 else mine[1], frame
            else:
                ended(video)
        due = [(frame + 1) * step for _, frame in waiting]
        for video in videos.keys() - {video for video, _ in waiting}:
            close = (videos[video][0] + 1) * step + idle
            if close <= watermark:
                ended(video)
            elif videos[video][1] >= 0:
                due.append(close)
        known = zip(*((video, *numbers) for video, numbers in videos.items()))
        state.update((*map(list, known), *map(list, zip(*waiting) if waiting else ([], [])), list(waiting.values())))
        if due:
            state.setTimeoutTimestamp(max(1, min(due) - 1))  # it comes once the watermark is beyond it
        if out:
            yield pd.DataFrame(out, columns=["video", "cut"])

    return step_of


def streamed_cuts(frames: DataFrame, threshold: float, least: int, step: int, delay: str, idle: int, groups: int = 1024) -> DataFrame:
    """Kept cuts of a stream of video, frame, prob, ts, in whatever order frames come within ``delay``: video, cut. ``step`` and ``idle``: milliseconds of a frame, and without one
    after which a video has ended. Frames later than the delay are the stream's own late rows (it counts them); rows without a video belong to none. Videos are dealt in
    ``groups`` by a hash, as a call and a state for each video cost far more than its frames; a group's state is read and written whole, so take one for every few hundred videos."""
    group = F.pmod(F.xxhash64("video"), F.lit(groups))
    rows = frames.where(F.col("video").isNotNull()).withColumn("group", group).withWatermark("ts", delay).groupBy("group")
    return rows.applyInPandasWithState(kept_cuts(threshold, least, step, idle), "video long, cut long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of each video, a session ending after ``gap`` without an event: video, start, end, n, peak."""
    events = events.withWatermark("ts", delay) if events.isStreaming else events
    rows = events.groupBy("video", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("prob").alias("peak"))
    return rows.select("video", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def unseen(frames: DataFrame, store: DataFrame, key: str = "frame_hash") -> DataFrame:
    """Rows whose hash no earlier run has seen, once each."""
    return frames.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def infer_into(frames: DataFrame, batch: int, store: str, infer: Callable[[DataFrame], DataFrame], key: str = "frame_hash") -> None:
    """One batch of a stream of frames: ``infer`` what is unseen and put it into the ``store``, a folder of one part for each batch. A batch that comes again after a
    failure finds its part whole and infers nothing, or replaces what was left of it; other parts are never touched. So each hash is in the store once."""
    spark = frames.sparkSession
    files, where = file_system(spark, store)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if files.exists(path(f"{store}/batch={batch}/_SUCCESS")):
        return
    earlier = [str(f.getPath()) for f in (files.listStatus(where) if files.exists(where) else []) if 0 <= int(str(f.getPath().getName()).partition("=")[2] or -1) < batch]
    new = unseen(frames, spark.read.parquet(*earlier), key) if earlier else frames.dropDuplicates([key])
    infer(new).write.mode("overwrite").parquet(f"{store}/batch={batch}")


def inferred(spark: SparkSession, store: str) -> DataFrame:
    """All that the store has, with the batch that it came in."""
    return spark.read.option("basePath", store).parquet(f"{store}/batch=*")


def infer_to_end(frames: DataFrame, store: str, checkpoint: str, infer: Callable[[DataFrame], DataFrame], key: str = "frame_hash") -> None:
    """Infer all frames of a stream that are there now, each hash once over all runs with this store and checkpoint."""
    writer = frames.writeStream.foreachBatch(lambda rows, batch: infer_into(rows, batch, store, infer, key))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, sf_dir: str, name: str, at_once: int = 1000) -> DataFrame:
    """A table of the folder, one file or a folder of files, as a stream of its files, so many in a batch."""
    path = f"{sf_dir}/{name}.parquet"
    files, where = file_system(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_once)
    if files.getFileStatus(where).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all there is now, exactly once, and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
