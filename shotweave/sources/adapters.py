"""General tables as the entities that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..params import Grouping
from .tables import exact_unions

SHOTS_PER_VIDEO, SHOT_SECONDS = 50, 4.0
#: A value over this is a transition.
EVENT_THRESHOLD = 79.7
#: Vectors of no cluster structure need other thresholds than a scene's.
EMBEDDING_GROUPING = Grouping(clip_floor=-1.0, abs_threshold=0.37, depth_threshold=0.03, strong_threshold=0.43, min_scene_seconds=10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    exact_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each user, a frame for each event in order: video, frame, prob, seconds, event_type."""
    w = Window.partitionBy("user_id").orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(micros).over(Window.partitionBy("user_id"))
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("video"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("prob"), ((micros - first) / 1e6).alias("seconds"), "event_type")


def event_videos(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    return frames.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames")).select("video", "n_frames", F.lit(fps).alias("fps"), (F.col("n_frames") / fps + 0.02).alias("duration"))


def embedding_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video of 50 vectors: video, shot, start, end, clip, color, phash, label, duration."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), F.col("label").cast("long").alias("label"))
    shot = F.pmod("vec_id", F.lit(SHOTS_PER_VIDEO))
    return rows.select(
        F.floor(F.col("vec_id") / SHOTS_PER_VIDEO).alias("video"), shot.alias("shot"), (shot * SHOT_SECONDS).alias("start"), ((shot + 1) * SHOT_SECONDS).alias("end"),
        vec.normalized("v").alias("clip"), vec.l1_normalized(F.transform(F.slice("v", 1, 16), F.abs)).alias("color"), vec.bits_to_long(F.transform("v", lambda x: x > 0)).alias("phash"), "label",
    )


def label_boundaries(shots: DataFrame) -> DataFrame:
    """True boundaries where the label changes: video, time."""
    w = Window.partitionBy("video").orderBy("shot")
    return shots.withColumn("before", F.lag("label").over(w)).where("before <> label").select("video", F.col("start").alias("time"))


#: Lines of a partition, about, where a scene's rows are brought together.
PART_LINES = 50_000


def line_parts(lines: DataFrame) -> int:
    """Partitions of scenes for so many lines: a task's memory stays the same as the table grows."""
    return max(1, -(-lines.count() // PART_LINES))


def by_scene(rows: DataFrame, scene: str, parts: int) -> DataFrame:
    """Whole scenes in each of so many partitions. Windows, aggregates and joins by the scene and more columns then need no further shuffle; of joins, Spark has to be told."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition(parts, scene)


def order_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each order, a detection for each line: scene, det (a number for lines in a full order), type_id, grp,
    score, x1, y1, x2, y2, shot, base (of the part). Lines with equal columns are equal detections."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    order = [c for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")]
    rows = by_scene(lines.join(part, lines["l_partkey"] == part["p_partkey"]), "l_orderkey", line_parts(lines))
    det = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    x, y = (F.col("l_linenumber") - 1) * 0.1, F.col("l_tax") * 5
    width = 0.1 + F.col("l_quantity") / 100
    return rows.select(
        F.col("l_orderkey").alias("scene"), det.alias("det"), F.col("p_type").alias("type_id"), F.col("p_brand").alias("grp"), (F.col("l_discount") * 10).alias("score"),
        x.alias("x1"), y.alias("y1"), F.least(F.lit(1.0), x + width).alias("x2"), F.least(F.lit(1.0), y + width).alias("y2"), F.pmod("l_suppkey", F.lit(5)).alias("shot"), (0.5 + F.col("p_size") / 100).alias("base"),
    )


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed detection for each labelled document: key, correct, flagged, category, type_id, confidence, relevance."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("flagged"), F.col("lang").alias("category"), F.col("source").alias("type_id"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("confidence"), (F.pmod("doc_id", F.lit(10)) / 10.0).alias("relevance"),
    )
