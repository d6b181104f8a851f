"""Canny: blurred byte levels, gradients, thinning and hysteresis, one image to a task (large images: see ``strips``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auto_thresholds(median: float, sigma: float = 0.33) -> tuple[float, float]:
    """(low, high) on the 0 to 255 scale."""
    low = max(10.0, (1.0 - sigma) * median)
    return low, min(255.0, max(2.0 * low, (1.0 + sigma) * median))


def thresholds_of(counted: DataFrame, low: float | None = None, high: float | None = None, sigma: float = 0.33) -> DataFrame:
    """(image_id, low, high) from counts of blurred byte levels (image_id, level, c); given thresholds go before those of the median."""
    medians = counted.groupBy("image_id").agg(F.expr("percentile(level, 0.5D, c)").alias("median"))
    auto = F.greatest(F.lit(10.0), (1.0 - sigma) * F.col("median"))
    upper = F.least(F.lit(255.0), F.greatest(2.0 * auto, (1.0 + sigma) * F.col("median")))
    return medians.select("image_id", (auto if low is None else F.lit(float(low))).alias("low"), (upper if high is None else F.lit(float(high))).alias("high"))


def blurred_levels(pixels: DataFrame, blur: int = 3) -> DataFrame:
    """``level``: byte levels under a Gaussian of 3 x 3 (or none), as integers; borders are reflected without repeating the edge."""
    if blur not in (0, 1, 3):
        raise ValueError("columns blur by 3 or not at all")
    levels = pixels.withColumn("level", F.floor(F.least(F.greatest(F.col("v") * 255, F.lit(0.0)), F.lit(255.0))).cast("int"))
    if blur < 3:
        return levels
    for along, across in (("x", "y"), ("y", "x")):
        w, v = Window.partitionBy("image_id", across).orderBy(along), F.col("level")
        levels = levels.withColumn("level", F.coalesce(F.lag(v).over(w), F.lead(v).over(w), v) + 2 * v + F.coalesce(F.lead(v).over(w), F.lag(v).over(w), v))
    return levels.withColumn("level", F.floor((F.col("level") + 8) / 16).cast("int"))


def threshold_table(pixels: DataFrame, sigma: float = 0.33, blur: int = 3) -> DataFrame:
    """(image_id, low, high) from the medians of blurred byte levels."""
    return thresholds_of(blurred_levels(pixels, blur).groupBy("image_id", "level").agg(F.count(F.lit(1)).alias("c")), sigma=sigma)


def byte_levels(v: np.ndarray) -> np.ndarray:
    return np.clip(v * 255.0, 0, 255).astype(np.uint8)


def blurred(levels: np.ndarray, size: int, top: bool = False, bottom: bool = False) -> np.ndarray:
    """Gaussian blur of byte levels; borders reflected without repeating the edge.

    With ``top`` or ``bottom`` the first or last size // 2 lines are neighbours, which the result leaves out.
    """
    if size <= 1:
        return levels
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = {3: np.array([0.25, 0.5, 0.25]), 5: np.array([1, 4, 6, 4, 1]) / 16.0}.get(size)
    if k is None:
        at = np.arange(size) - (size - 1) / 2
        k = np.exp(-at * at / (2 * sigma * sigma))
        k /= k.sum()
    r = size // 2
    out = levels.astype(np.float64)
    for axis in (0, 1):
        mode = "reflect" if out.shape[axis] > r else "edge"
        pads = (0 if top else r, 0 if bottom else r) if axis == 0 else (r, r)
        padded = np.pad(out, [pads if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        n = padded.shape[axis] - 2 * r
        out = sum(w * (padded[j : j + n] if axis == 0 else padded[:, j : j + n]) for j, w in enumerate(k))
    return np.floor(out + 0.5).astype(np.uint8)


#: tan(22.5 degrees) in 15-bit fixed point, as the published algorithm has it.
_TAN, _ONE = 13573, 1 << 15


def thinned(levels: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(thin pixels above the upper threshold, all thin pixels above the lower) of blurred byte levels."""
    p = np.pad(levels.astype(np.int32), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]
    ax, ay = np.abs(gx), np.abs(gy)
    m = ax + ay
    q = np.pad(m, 1)
    h, w = m.shape

    def at(dy: int, dx: int) -> np.ndarray:
        return q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    flat, steep = ay * _ONE < ax * _TAN, ay * _ONE > ax * (_TAN + 2 * _ONE)
    same = (gx ^ gy) >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    # On a plateau the first of two equal neighbours stays; on a diagonal neither does.
    thin = (m > low) & (m > before) & np.where(flat | steep, m >= after, m > after)
    return thin & (m > high), thin


def spread(found: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """``found`` with all ``weak`` pixels that are joined to it by neighbours, diagonal ones included."""
    h, w = found.shape
    width = w + 2
    front = np.flatnonzero(found)
    weak, out = np.pad(weak, 1).reshape(-1), np.pad(found, 1).reshape(-1)
    place = (front // w + 1) * width + front % w + 1
    steps = np.array([dy * width + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    while len(place):
        near = np.unique((place[:, None] + steps).reshape(-1))
        place = near[weak[near]]
        weak[place] = False
        out[place] = True
    return out.reshape(h + 2, width)[1:-1, 1:-1]


def canny(v: np.ndarray, low: float | None = None, high: float | None = None, blur: int = 3) -> np.ndarray:
    """The edge mask of intensities in [0, 1]."""
    levels = blurred(byte_levels(v), blur)
    auto = auto_thresholds(float(np.median(levels)))
    found, thin = thinned(levels, auto[0] if low is None else low, auto[1] if high is None else high)
    return spread(found, thin & ~found)


def detect(pixels: DataFrame, low: float | None = None, high: float | None = None, blur: int = 3) -> DataFrame:
    """``m`` of 0 or 1 for every pixel. Lines are packed before images are grouped; a group is one image, as hysteresis needs it."""
    lines = pixels.groupBy("image_id", "h", "w", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda z: z["v"]).alias("line"))

    def run(table):
        table = table.sort_by("y")
        image_id, h, w = (table[c][0].as_py() for c in ("image_id", "h", "w"))
        edges = canny(np.array(table["line"].to_pylist(), dtype=np.float64).reshape(h, w), low, high, blur)
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
        full = lambda n: pa.array(np.full(h * w, n, np.int32))
        return pa.table({"image_id": pa.array([image_id] * (h * w)), "h": full(h), "w": full(w), "y": pa.array(y), "x": pa.array(x), "m": pa.array(edges.reshape(-1).astype(np.float64))})

    return lines.groupBy("image_id").applyInArrow(run, "image_id string, h int, w int, y int, x int, m double")
