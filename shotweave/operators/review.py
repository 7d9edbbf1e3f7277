"""Reviewed detections: verdicts, precision, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flat thresholds that a report tries.
THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7)


def precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """reviewed, correct, wrong, precision (null where nothing is reviewed). ``rows``: verdict ('correct' or 'wrong')."""
    c, w = F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") == "wrong")
    return rows.groupBy(*by).agg((c + w).alias("reviewed"), c.alias("correct"), w.alias("wrong"), F.round(c / F.nullif(c + w, F.lit(0)), 4).alias("precision"))


def precision_sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Precision overall and by each key alone, in one pass: the keys (null where not grouped by) and the figures."""
    c, w = F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") == "wrong")
    sets = rows.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys])
    return sets.agg((c + w).alias("reviewed"), c.alias("correct"), w.alias("wrong"), F.round(c / F.nullif(c + w, F.lit(0)), 4).alias("precision"))


def shown(confidence: Column, relevance: Column, need: Column, min_relevance: float) -> Column:
    return (confidence >= need) & (relevance >= min_relevance)


def tier_need(tier: Column, floor: float) -> Column:
    """What confidence a type needs; unknown types need all of it."""
    return F.greatest(F.lit(floor), F.coalesce(tier, F.lit(1.0)))


def threshold_sweep(rows: DataFrame, min_relevance: float, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Precision of what each flat threshold would show."""
    rows = rows.where(F.col("relevance") >= min_relevance).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = precision(rows.where(F.col("confidence") >= F.col("threshold")), ["threshold"])
    every = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return every.join(out, "threshold", "left").na.fill(0, ["reviewed", "correct", "wrong"])


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last verdict for each key; a cleared one is none. ``events``: seq, verdict ('' to clear)."""
    return events.groupBy(*keys).agg(F.max_by("verdict", "seq").alias("verdict")).where("verdict <> ''")
