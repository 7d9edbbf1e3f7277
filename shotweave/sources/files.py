"""Labels, splits, reviews, manifests and results as JSON files and tables: readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import label_error
from .media import stem
from .tables import file_system

LABEL = "video string, boundaries array<double>, annotator string, notes string, provenance struct<method:string>, _corrupt string"
REVIEW = "verdict string, type_id string, category string, scene_id int, detection_confidence double, commercial_relevance double, displayed boolean, detector_key string"
#: Files of a label folder that aren't labels.
RESERVED = ("splits", "provenance", "videos_manifest")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """stem, video, boundaries, annotator, notes, provenance, and error for a file that isn't JSON."""
    rows = spark.read.schema(LABEL).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    name = stem(F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B")))
    rows = rows.select(name.alias("stem"), "*").where(~F.col("stem").isin(*RESERVED))
    return rows.withColumn("error", F.when(F.col("_corrupt").isNotNull(), "not JSON")).drop("_corrupt")


def validated(labels: DataFrame, durations: DataFrame) -> DataFrame:
    """``labels`` with an error for lists that break a rule. ``durations``: stem, duration."""
    rows = labels.join(durations, "stem", "left")
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("duration").isNull(), "no such video"), label_error(F.col("boundaries"), F.col("duration")))).drop("duration")


def boundaries(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("stem").alias("video"), F.explode("boundaries").alias("time"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """stem, role from lists by role; a name in two roles is refused."""
    rows = spark.read.schema("dev array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    roles = rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("dev", "val", "test"))), F.array("dev", "val", "test"))).alias("role", "stems"))
    roles = roles.select("role", F.explode("stems").alias("stem"))
    if twice := [r.stem for r in roles.groupBy("stem").agg(F.countDistinct("role").alias("n")).where("n > 1").limit(5).collect()]:
        raise ValueError(f"in more than one role: {twice}")
    return roles.select("stem", "role")


def with_roles(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """``labels`` with their role; 'unassigned' for none."""
    return labels.join(splits, "stem", "left").withColumn("role", F.coalesce("role", F.lit("unassigned")))


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each reviewed candidate of all files that are JSON: video, key and the review's fields."""
    fields = ", ".join(f.replace(" ", ":") for f in REVIEW.split(", "))
    rows = spark.read.schema(f"video string, reviews map<string, struct<{fields}>>").option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return rows.select("video", F.explode("reviews").alias("key", "r")).select("video", "key", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video string, label string, bytes long, sha256 string, duration_seconds double, resolution string, fps double").option("multiLine", True).json(path)


def read_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Stored detections; lines that aren't JSON are set aside in ``corrupt``."""
    schema = "video string, shot long, position double, type_id string, prompt string, score double, x1 double, y1 double, x2 double, y2 double, frame_hash string, corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(folder)


def read_shots(spark: SparkSession, folder: str) -> DataFrame:
    """Shots from records that hold a list: video, shot, start_frame, end_frame, start, end."""
    rows = spark.read.schema("video string, shots array<struct<index:long, start_frame:long, end_frame:long, start:double, end:double>>").option("multiLine", True).json(folder)
    return rows.select("video", F.inline("shots")).withColumnRenamed("index", "shot")


# --- writers ---------------------------------------------------------------------------------------
def replace_table(df: DataFrame, path: str) -> None:
    """The whole table, written beside the old one and renamed into its place once it is complete: a write that fails
    leaves the old one as it was. ``df`` may read the old table."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}-{name}-new")
    files, old = file_system(spark, path)
    new, aside = (file_system(spark, f"{path}-{name}-{state}")[1] for state in ("new", "old"))
    there = files.exists(old)
    if there and not files.rename(old, aside):
        raise OSError(f"{path} can't be moved aside")
    if not files.rename(new, old):
        if there:
            files.rename(aside, old)
        raise OSError(f"{path} can't be put in place")
    if there:
        files.delete(aside, True)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a log of operations or verdicts; what holds now is a fold or the last of each key."""
    df.write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """A JSON document a line, from a column ``document``."""
    df.select("document").write.mode("overwrite").text(path)


def label_documents(labels: DataFrame) -> DataFrame:
    """What is stored of labels: boundaries in order, to 3 places. ``labels``: stem, video, boundaries, annotator, notes, method."""
    b = F.array_sort(F.transform("boundaries", lambda x: F.bround(x, 3)))
    body = F.struct("video", b.alias("boundaries"), "annotator", "notes", F.struct("method").alias("provenance"))
    return labels.select("stem", F.to_json(body).alias("document"))


def report_lines(rows: DataFrame, title: str) -> list[str]:
    """A table of a few rows as Markdown."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "-" if v is None else str(v)
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return [f"## {title}", *head, *["| " + " | ".join(map(cell, r)) + " |" for r in rows.collect()]]


def dataset(labels: DataFrame, splits: DataFrame, videos: DataFrame, roles: list[str]) -> DataFrame:
    """Valid labels of the given roles whose video is there: stem, role, boundaries, path, duration. ``videos``: stem, path,
    duration. Names without a role are never used."""
    rows = with_roles(validated(labels, videos.select("stem", "duration")).where("error IS NULL"), splits)
    return rows.where(F.col("role").isin(*roles)).join(videos, "stem").select("stem", "role", "boundaries", "path", "duration")
