"""Names of colours from hue (degrees), saturation and value (0 to 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where each hue begins and ends, in degrees.
HUES = [("red", 0, 15), ("orange", 15, 40), ("yellow", 40, 70), ("green", 70, 165), ("blue", 165, 260), ("purple", 260, 300), ("pink", 300, 340), ("red", 340, 361)]
DARK, PALE, BRIGHT = 0.18, 0.16, 0.78


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of components from 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(top - low, F.lit(0.0))
    h = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct(F.coalesce(F.pmod(h * 60, F.lit(360.0)), F.lit(0.0)).alias("h"), F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("s"), top.alias("v"))


def name(h: Column, s: Column, v: Column) -> Column:
    """black, white or grey, else the hue; dark warm hues are brown, pale ones beige."""
    hue = reduce(lambda w, x: w.when((h >= x[1]) & (h < x[2]), x[0]), HUES[1:], F.when((h >= HUES[0][1]) & (h < HUES[0][2]), HUES[0][0]))
    warm = hue.isin("orange", "yellow")
    coloured = F.when(warm & (s < 0.35) & (v >= 0.55), "beige").when(warm & (v < 0.55) & (h < 50), "brown").otherwise(hue)
    return F.when(v < DARK, "black").when((s < PALE) & (v > BRIGHT), "white").when(s < PALE, "grey").otherwise(coloured)


def dominant(pixels: DataFrame, keys: list[str], least: float = 0.55) -> DataFrame:
    """The commonest colour of each box if its share is large enough, else null; the first in the alphabet on ties.
    ``pixels``: keys and color."""
    counts = pixels.groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "color")).alias("b"), F.sum("c").alias("n"))
    share = -F.col("b.c") / F.col("n")
    return best.select(*keys, F.when(share >= least, F.col("b.color")).alias("color"), share.alias("share"))


def central(rows: DataFrame, inner: float = 0.6) -> DataFrame:
    """Pixels in the middle of a box, where there is less background. ``rows``: px, py, x1, y1, x2, y2 as fractions."""
    edge = (1 - inner) / 2
    x, y = (F.col("x2") - F.col("x1")) * edge, (F.col("y2") - F.col("y1")) * edge
    return rows.where(F.col("px").between(F.col("x1") + x, F.col("x2") - x) & F.col("py").between(F.col("y1") + y, F.col("y2") - y))
