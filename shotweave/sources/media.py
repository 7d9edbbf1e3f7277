"""What a prober says about videos, names and paths, and the interface to models that run on frames."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the prober's output, suffixes, and bytes that an id is made from.
DURATION = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
STREAM = r"Stream #\S+.*?: Video: (\w+).*?, (\d{2,5})x(\d{2,5})"
RATE = r"Video:.*?(\d+(?:\.\d+)?) (?:fps|tbr)"
ROTATION = r"rotation of (-?\d+(?:\.\d+)?) degrees"
VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "webm", "avi", "m4v")
HEAD = 4 << 20


def probed(texts: DataFrame) -> DataFrame:
    """Fields of a prober's output: video, duration, fps, width, height, has_audio, codec, error. ``texts``: video, text.
    Pictures turned by 90 degrees swap their sides; what can't be read has an error and nulls."""
    part = lambda pattern, n: F.nullif(F.regexp_extract("text", pattern, n), F.lit(""))
    seconds = part(DURATION, 1).cast("double") * 3600 + part(DURATION, 2).cast("double") * 60 + part(DURATION, 3).cast("double")
    turned = F.abs(F.abs(part(ROTATION, 1).cast("double")) - 90) < 1
    w, h = part(STREAM, 2).cast("int"), part(STREAM, 3).cast("int")
    fps = part(RATE, 1).cast("double")
    error = F.when(w.isNull(), "no video stream").when(~(F.coalesce(seconds, F.lit(0.0)) > 0) | ~(F.coalesce(fps, F.lit(0.0)) > 0), "no duration or rate")
    swap = F.coalesce(turned, F.lit(False))
    return texts.select("video", F.round(seconds, 3).alias("duration"), fps.alias("fps"), F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"), F.col("text").rlike(r"Stream #\S+.*?: Audio:").alias("has_audio"), part(STREAM, 1).alias("codec"), error.alias("error"))


def scaled_size(width: Column, height: Column, short: int) -> Column:
    """Width and height with the given short side, both even."""
    even = lambda x: x + F.pmod(x, F.lit(2))
    tall = width <= height
    w = F.when(tall, F.lit(short)).otherwise(F.bround(width * short / height).cast("int"))
    h = F.when(tall, F.bround(height * short / width).cast("int")).otherwise(F.lit(short))
    return F.struct(even(w).alias("width"), even(h).alias("height"))


def content_ids(files: DataFrame) -> DataFrame:
    """path and an id of 16 hex digits from size, beginning and end. ``files`` as read by ``binaryFile``."""
    edge = F.concat(F.substring("content", 1, HEAD), F.substring("content", -HEAD, HEAD))
    return files.select("path", F.substring(F.sha1(F.concat(F.col("length").cast("string").cast("binary"), edge)), 1, 16).alias("video_id"), "length")


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """Names in Unicode's composed form, so that equal names are equal; Spark has no function for it."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n))


def join_by_name(left: DataFrame, right: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Join two tables on a name whatever its Unicode form."""
    a, b = left.withColumn("_name", composed(name)), right.withColumn("_name", composed(name)).drop(name)
    return a.join(b, "_name", how).drop("_name")


def stem(path: Column) -> Column:
    """The file name without folders and suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def accepted_uploads(files: DataFrame) -> DataFrame:
    """Files of known suffixes, one for each content id: the first by path."""
    known = files.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*VIDEO_SUFFIXES))
    return known.groupBy("video_id").agg(F.min("path").alias("path"))


#: Where a video is looked for, first found first.
PRIORITY = ("video", "upload", "cache")


def resolved(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """The best place of each wanted stem: stem, kind ('missing' for none), path. ``places``: stem, kind, path."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    w = Window.partitionBy("stem").orderBy(rank, "path")
    best = places.where(rank > 0).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("stem", "kind", "path")
    return wanted.select("stem").distinct().join(best, "stem", "left").select("stem", F.coalesce("kind", F.lit("missing")).alias("kind"), "path")


# Fixed value: the flag by which a file system marks a file whose bytes are elsewhere.
DATALESS = 0x40000000


def dataless(flags: Column) -> Column:
    """Whether a file is a placeholder, by its flags (null where the file system has none)."""
    return F.coalesce(flags.bitwiseAND(F.lit(DATALESS)) != 0, F.lit(False))


def relocated(recorded: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """Where recorded paths are now: video, recorded, path, status. ``recorded``: video, path. ``files``: path and flags of all files there are.

    A path that exists is 'here'; else the file of the same name in the first of the ``folders`` that has one is where it was 'moved'; else the recorded path is
    'missing'. A file found whose bytes are elsewhere is a 'placeholder'. Repeated rows give repeated rows."""
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rank = F.array_position(F.array(*[F.lit(f.rstrip("/")) for f in folders]).cast("array<string>"), folder)
    known = files.groupBy("path").agg(F.bit_or(F.coalesce("flags", F.lit(0)).cast("long")).alias("flags"))
    there = known.where(rank > 0).groupBy(name.alias("name")).agg(F.min(F.struct(rank.alias("rank"), "path", "flags")).alias("moved"))
    rows = recorded.select("video", F.col("path").alias("recorded"), name.alias("name")).join(known.withColumnsRenamed({"path": "recorded", "flags": "own"}), "recorded", "left").join(there, "name", "left")
    here = F.col("own").isNotNull()
    flags = F.when(here, F.col("own")).otherwise(F.col("moved.flags"))
    status = F.when(flags.isNull(), "missing").when(dataless(flags), "placeholder").when(here, "here").otherwise("moved")
    return rows.select("video", "recorded", F.when(here, F.col("recorded")).otherwise(F.coalesce("moved.path", "recorded")).alias("path"), status.alias("status"))


# --- models ----------------------------------------------------------------------------------------
#: A model's factory by name; it is called once in each worker and returns a function of a frame of rows.
Model = Callable[[pd.DataFrame], pd.DataFrame]
MODELS: dict[str, Callable[[], Model]] = {}


class ModelUnavailable(RuntimeError):
    pass


def register(name: str, factory: Callable[[], Model]) -> None:
    MODELS[name] = factory


def applied(frames: DataFrame, name: str, schema: str) -> DataFrame:
    """Run a registered model over batches of frames; it is loaded once in a worker."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}")
    factory = MODELS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)


def detections_or_none(spark: SparkSession, make: Callable[[], DataFrame], schema: str) -> tuple[DataFrame, str]:
    """Detections and a status; where the model is unavailable none, so that what doesn't need them still runs."""
    try:
        return make(), "ready"
    except ModelUnavailable:
        return spark.createDataFrame([], schema), "unavailable"
