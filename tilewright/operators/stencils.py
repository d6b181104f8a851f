"""Stencils over pixels(image_id, h, w, y, x, v): windows along rows and columns, borders replicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("image_id", "h", "w", "y", "x")


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def right(c: Column) -> Column:
    return F.coalesce(F.lead(c).over(_row()), c)


def left(c: Column) -> Column:
    return F.coalesce(F.lag(c).over(_row()), c)


def below(c: Column) -> Column:
    return F.coalesce(F.lead(c).over(_column()), c)


def above(c: Column) -> Column:
    return F.coalesce(F.lag(c).over(_column()), c)


def oriented(pixels: DataFrame) -> DataFrame:
    """Signed differences ``gh`` to the right and ``gv`` to the lower neighbour."""
    v = F.col("v")
    return pixels.withColumn("gh", v - right(v)).withColumn("gv", v - below(v))


def qhed(pixels: DataFrame) -> DataFrame:
    """Edge magnitude. Tiles with a halo give the same (see operators.tiling), so none are made here."""
    return oriented(pixels).select(*KEYS, F.sqrt(F.col("gh") * F.col("gh") + F.col("gv") * F.col("gv")).alias("m"))


def _two_passes(pixels: DataFrame, smooth: float) -> DataFrame:
    v = F.col("v")
    rows = pixels.withColumns({"s": left(v) + smooth * v + right(v), "d": right(v) - left(v)})
    d, s = F.col("d"), F.col("s")
    both = rows.withColumns({"gx": above(d) + smooth * d + below(d), "gy": below(s) - above(s)})
    return both.select(*KEYS, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("m"))


def sobel(pixels: DataFrame) -> DataFrame:
    """3x3 Sobel magnitude, not normalised."""
    return _two_passes(pixels, 2.0)


def prewitt(pixels: DataFrame) -> DataFrame:
    """3x3 Prewitt magnitude, not normalised."""
    return _two_passes(pixels, 1.0)


def laplacian(pixels: DataFrame) -> DataFrame:
    """|v * K| with K = [[2, 0, 2], [0, -8, 0], [2, 0, 2]]."""
    v, e = F.col("v"), F.col("e")
    rows = pixels.withColumn("e", left(v) + right(v))
    return rows.withColumn("m", F.abs(2.0 * (above(e) + below(e)) - 8.0 * v)).select(*KEYS, "m")


def label_edges(labels: DataFrame) -> DataFrame:
    """Whether the right or lower neighbour has another label."""
    label = F.col("label")
    return labels.withColumn("e", (label != right(label)) | (label != below(label))).select(*KEYS, "label", "e")


#: Detectors by name: pixels to magnitudes ``m``.
DETECTORS = {"qhed": qhed, "sobel": sobel, "prewitt": prewitt, "laplacian": laplacian}
