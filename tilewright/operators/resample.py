"""Downscaling by area averages, as two joins with tables of overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def target_size(height: int, width: int, max_side: int) -> tuple[int, int]:
    """The size whose longer side is at most ``max_side``; halves round to even; never larger than before."""
    scale = min(1.0, max_side / max(height, width))
    return max(1, round(height * scale)), max(1, round(width * scale))


def overlaps(spark: SparkSession, size: int, target: int, old: str, new: str, weight: str) -> DataFrame:
    """How much of each target cell each old one covers: at most size + target rows."""
    cell = size / target
    return (
        spark.range(target)
        .select(F.col("id").cast("int").alias(new))
        .withColumn(old, F.explode(F.sequence(F.floor(F.col(new) * F.lit(cell)).cast("int"), F.least(F.lit(size - 1), F.ceil((F.col(new) + 1) * F.lit(cell)).cast("int") - 1))))
        .withColumn(weight, (F.least((F.col(new) + 1) * F.lit(cell), F.col(old) + F.lit(1.0)) - F.greatest(F.col(new) * F.lit(cell), F.col(old).cast("double"))) / F.lit(cell))
        .where(F.col(weight) > 1e-12)
    )


def resize(pixels: DataFrame, height: int, width: int, max_side: int, clip: bool = True) -> DataFrame:
    """Pixels of images of one size, scaled to ``max_side``; the input itself where it fits."""
    h, w = target_size(height, width, max_side)
    if (h, w) == (height, width):
        return pixels
    spark = pixels.sparkSession
    # Tables of a few thousand rows, whatever the number of images.
    wy, wx = overlaps(spark, height, h, "y", "oy", "wy"), overlaps(spark, width, w, "x", "ox", "wx")
    joined = pixels.join(F.broadcast(wy), "y").join(F.broadcast(wx), "x")
    v = F.sum(F.col("v") * F.col("wy") * F.col("wx"))
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if clip else v
    out = joined.groupBy("image_id", "oy", "ox").agg(v.alias("v"))
    return out.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.col("oy").alias("y"), F.col("ox").alias("x"), "v")
