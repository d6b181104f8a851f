"""Quality of edge maps against a reference: joins on (image_id, y, x) and grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["image_id", "y", "x"]


def aligned(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Pixels of both with ``a`` and ``b``; raises where the images' sizes differ or one of them lacks a pixel."""
    x = a.select("image_id", "h", "w", "y", "x", F.col(value).alias("a"))
    y = b.select(*PIXEL, F.col("h").alias("h2"), F.col("w").alias("w2"), F.col(value).alias("b"))
    # An outer join costs what an inner one does, and pixels without a partner don't vanish.
    checked = F.when((F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2")), F.col("a")).otherwise(F.raise_error(F.lit("images differ in size")))
    return x.join(y, PIXEL, "full").withColumn("a", checked).drop("h2", "w2")


def _at_most_one(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(1 / mse))


def psnr(pairs: DataFrame) -> DataFrame:
    """10 log10(1 / mean squared difference); infinite at 0."""
    return pairs.groupBy("image_id").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse")).select("image_id", _at_most_one(F.col("mse")).alias("psnr"))


def ssim(pairs: DataFrame, side: int = 7) -> DataFrame:
    """Mean structural similarity over the places where a window of ``side`` fits; sample covariances.

    Images smaller than that use the largest odd side that fits; below 3 it is 1 for equal images and 0 otherwise.
    """
    smallest = F.least(F.col("h"), F.col("w"), F.lit(side))
    sized = pairs.withColumn("n", smallest - F.when(smallest % 2 == 0, 1).otherwise(0))
    tiny = sized.where("n < 3").groupBy("image_id").agg(F.when(F.max(F.abs(F.col("a") - F.col("b")) - 1e-8 - 1e-5 * F.abs("b")) <= 0, 1.0).otherwise(0.0).alias("ssim"))
    parts = []
    for n in range(3, side + 1, 2):
        r = n // 2
        own = sized.where(F.col("n") == n)
        row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)
        column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)
        a, b = F.col("a"), F.col("b")
        terms = {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}
        sums = own.withColumns({k: F.sum(v).over(row) for k, v in terms.items()})
        sums = sums.withColumns({k: F.sum(k).over(column) / (n * n) for k in terms})
        ux, uy, c = F.col("sa"), F.col("sb"), n * n / (n * n - 1)
        vx, vy, vxy = c * (F.col("saa") - ux * ux), c * (F.col("sbb") - uy * uy), c * (F.col("sab") - ux * uy)
        c1, c2 = 0.01**2, 0.03**2
        s = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
        inside = (F.col("y") >= r) & (F.col("y") < F.col("h") - r) & (F.col("x") >= r) & (F.col("x") < F.col("w") - r)
        parts.append(sums.where(inside).groupBy("image_id").agg(F.avg(s).alias("ssim")))
    for part in parts:
        tiny = tiny.unionByName(part)
    return tiny


def edge_density(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image_id").agg(F.coalesce(F.avg(F.col("e").cast("int")), F.lit(0.0)).alias("edge_density"))


def within(mask: DataFrame, target: DataFrame, tolerance: float) -> DataFrame:
    """The pixels of ``mask`` with one of ``target`` at most ``tolerance`` away: target pixels are spread over the offsets of the disc, then semi-joined."""
    r = math.floor(tolerance)
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= tolerance * tolerance]
    disc = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    near = target.where("e").select("image_id", "y", "x", F.explode(disc).alias("o")).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return mask.where("e").join(near, PIXEL, "left_semi")


def edge_scores(prediction: DataFrame, reference: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Precision, recall and F1 by image. Both empty: 1, 1, 1; one empty: 0, 0, 0."""
    count = lambda df, name: df.groupBy("image_id").agg(F.sum(F.col("e").cast("int")).alias(name))
    hits = lambda df, name: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    joined = (
        count(prediction, "np").join(count(reference, "nr"), "image_id")
        .join(hits(within(prediction, reference, tolerance), "hp"), "image_id", "left")
        .join(hits(within(reference, prediction, tolerance), "hr"), "image_id", "left")
        .fillna(0, ["hp", "hr"])
    )
    both, one = (F.col("np") == 0) & (F.col("nr") == 0), (F.col("np") == 0) | (F.col("nr") == 0)
    share = lambda a, b: F.when(both, 1.0).when(one, 0.0).otherwise(F.col(a) / F.col(b))
    scored = joined.select("image_id", share("hp", "np").alias("precision"), share("hr", "nr").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def iou(prediction: DataFrame, reference: DataFrame) -> DataFrame:
    """Strict intersection over union; 1 where both are empty."""
    pairs = aligned(prediction, reference, "e")
    both, any_ = F.sum((F.col("a") & F.col("b")).cast("int")), F.sum((F.col("a") | F.col("b")).cast("int"))
    return pairs.groupBy("image_id").agg(F.when(any_ == 0, 1.0).otherwise(both / any_).alias("iou"))


def absolute_error(pairs: DataFrame) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy("image_id").agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))


def throughput(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(float("inf")))
