"""A deterministic scene with known boundaries, made by SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intensity of the background, rectangle, disc, triangle and small square; later shapes are painted over earlier ones.
INTENSITIES = (0.1, 0.85, 0.55, 0.7, 0.35)


#: Fixed places, as shares of the width (u) and height (v): the rectangle's and square's edges, the disc's centre and
#: radius (in widths), and the triangle's edges, axis and slope.
RECTANGLE = {"u": (0.08, 0.42), "v": (0.1, 0.55)}
DISC = {"u": 0.68, "v": 0.35, "radius": 0.18}
TRIANGLE = {"v": (0.65, 0.9), "axis": 0.5, "slope": 1.2}
SQUARE = {"u": (0.12, 0.3), "v": (0.7, 0.85)}


def _label_sql(y: str, x: str, h: int, w: int, double: str) -> str:
    """A CASE expression; ``double`` formats a number as a double of the dialect."""
    d = lambda n: double.format(repr(float(n)))
    u, v = f"({x} / {d(w)})", f"({y} / {d(h)})"
    inside = lambda shape: " and ".join(f"{c} > {d(shape[k][0])} and {c} < {d(shape[k][1])}" for k, c in (("u", u), ("v", v)))
    dx, dy = f"({u} - {d(DISC['u'])})", f"(({v} - {d(DISC['v'])}) * {d(h)} / {d(w)})"
    low, high = TRIANGLE["v"]
    return (
        f"case when {inside(SQUARE)} then 4 "
        f"when {v} > {d(low)} and {v} < {d(high)} and abs({u} - {d(TRIANGLE['axis'])}) < ({v} - {d(low)}) * {d(TRIANGLE['slope'])} then 3 "
        f"when {dx} * {dx} + {dy} * {dy} < {d(DISC['radius'])} * {d(DISC['radius'])} then 2 "
        f"when {inside(RECTANGLE)} then 1 else 0 end"
    )


def label(h: int, w: int) -> Column:
    """The shape at a pixel of columns y and x, 0 to 4."""
    return F.expr(_label_sql("y", "x", h, w, "{}D"))


def label_sql(h: int, w: int) -> str:
    """The same for DuckDB."""
    return _label_sql("y", "x", h, w, "{}::double")


def scene(spark: SparkSession, h: int = 256, w: int = 256, image_id: str = "scene") -> DataFrame:
    """pixels(image_id, h, w, y, x, label, v)."""
    if h < 8 or w < 8:
        raise ValueError("a scene is at least 8 x 8")
    base = spark.range(h * w).select(F.lit(image_id).alias("image_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    marked = base.withColumn("label", label(h, w))
    return marked.withColumn("v", F.get(F.array(*[F.lit(i) for i in INTENSITIES]), F.col("label")))


def sample(spark: SparkSession, h: int = 720, w: int = 1280, seed: int = 7) -> DataFrame:
    """The scene under a lighting gradient 0.12 x/w + 0.08 y/h with noise of deviation 0.012, as byte levels (halves to even)."""
    s = scene(spark, h, w, "sample")
    # Noise by key, so that partitions don't change it: Box-Muller over two hashes.
    u = lambda n: (F.pmod(F.xxhash64("y", "x", F.lit(seed), F.lit(n)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    noise = 0.012 * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    lit = F.col("v") + 0.12 * F.col("x") / w + 0.08 * F.col("y") / h + noise
    return s.withColumn("level", F.rint(F.least(F.greatest(lit, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).withColumn("v", F.col("level") / 255.0)
