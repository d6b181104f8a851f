"""What follows a detector: normalising, thresholds, differences, crops and byte levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import stencils

#: Peaks at most this large count as none.
PEAK = 1e-9


def normalise(magnitudes: DataFrame) -> DataFrame:
    """``m`` divided by its image's peak; zeros where there is none. The peaks, a row for each image, are joined back.

    Whether they are broadcast is left to the planner, which knows how many there are by then; where it shuffles,
    a large image's rows are split by adaptive execution.
    """
    peaks = magnitudes.groupBy("image_id").agg(F.max("m").alias("peak"))
    joined = magnitudes.join(peaks, "image_id")
    return joined.withColumn("m", F.when(F.col("peak") > PEAK, F.col("m") / F.col("peak")).otherwise(0.0)).drop("peak")


def over_pipeline(m: Column, threshold: float) -> Column:
    """m >= t, but m > 0 at t = 0."""
    return m >= threshold if threshold > 0 else m > 0


def over_classical(m: Column, threshold: float) -> Column:
    return m >= max(threshold, 1e-12)


def over_fixed(m: Column, threshold: float) -> Column:
    return m >= max(threshold, PEAK)


def adaptive(magnitudes: DataFrame, percentile: float = 85.0) -> DataFrame:
    """``e``: at least the percentile, linearly interpolated, of the image's values above PEAK; false without any."""
    cuts = magnitudes.where(F.col("m") > PEAK).groupBy("image_id").agg(F.expr(f"percentile(m, {percentile / 100}D)").alias("cut"))
    return magnitudes.join(cuts, "image_id", "left").withColumn("e", F.coalesce(F.col("m") >= F.greatest(F.col("cut"), F.lit(PEAK)), F.lit(False))).drop("cut")


def tile_normalised(px: Column) -> Column:
    """A tile divided by its largest value, or by 1 where that is 0."""
    return arrays.let(F.coalesce(F.nullif(F.array_max(px), F.lit(0.0)), F.lit(1.0)), lambda top: F.transform(px, lambda v: v / top))


def interior_sobel(pixels: DataFrame) -> DataFrame:
    """A quarter of the Sobel magnitude inside the image, 0 on its border: the variant that needs no values beyond it."""
    inside = (F.col("y") > 0) & (F.col("y") < F.col("h") - 1) & (F.col("x") > 0) & (F.col("x") < F.col("w") - 1)
    return stencils.sobel(pixels).withColumn("m", F.when(inside, F.col("m") / 4).otherwise(0.0))


def two_levels(m: Column, low: float = 0.05, high: float = 0.15) -> Column:
    """1 above ``high``, 0.5 above ``low``, else 0."""
    return F.when(m > high, 1.0).when(m > low, 0.5).otherwise(0.0)


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def byte_level(c: Column) -> Column:
    """0 to 255, halves up."""
    return F.floor(clip(c) * 255 + 0.5).cast("int")


def signed_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``diff``: a minus b, pixel by pixel; raises where the images' sizes differ or one of them lacks a pixel."""
    other = b.select("image_id", "y", "x", F.col("m").alias("other"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    same = (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2"))
    diff = F.when(same, F.col("m") - F.col("other")).otherwise(F.raise_error(F.lit("images differ in size")).cast("double"))
    return a.join(other, ["image_id", "y", "x"], "full").select("image_id", "h", "w", "y", "x", diff.alias("diff"))


def crop(pixels: DataFrame, side: int = 8) -> DataFrame:
    """The first min(side, h, w) rows and columns, its last ones repeated up to side x side."""
    inner = F.least(F.lit(side), F.col("h"), F.col("w"))
    inside = pixels.where((F.col("y") < inner) & (F.col("x") < inner)).withColumn("inner", inner)

    def spread(c: str) -> Column:
        last = F.col(c) == F.col("inner") - 1
        return F.when(last, F.sequence(F.col(c), F.lit(side - 1))).otherwise(F.array(F.col(c)))

    rows = inside.select("image_id", "inner", "x", "v", F.explode(spread("y")).alias("y"))
    return rows.select("image_id", F.lit(side).alias("h"), F.lit(side).alias("w"), "y", F.explode(spread("x")).alias("x"), "v")
