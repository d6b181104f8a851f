"""Whole runs: from pixels to normalised edges, and methods scored against a reference."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..config import EdgeConfig, ExecutorKind, Preset
from ..operators import backends, canny, metrics, post, resample, stencils, tiling

METHODS = ("qhed", "sobel", "prewitt", "canny", "laplacian")
#: Columns of a benchmark table.
COLUMNS = ("method", "runtime_s", "tiles_per_s", "megapixels_per_s", "ssim", "psnr", "precision", "recall", "f1", "iou", "edge_density", "peak_mem_mb")


def preprocess(pixels: DataFrame, height: int, width: int, config: EdgeConfig) -> tuple[DataFrame, int, int, EdgeConfig]:
    """Images of one size, scaled to what the config allows, with the size that results."""
    config, side, _ = config.limited()
    h, w = resample.target_size(height, width, side)
    return resample.resize(pixels, height, width, side), h, w, config


def magnitudes(pixels: DataFrame, config: EdgeConfig) -> DataFrame:
    """``m`` by the config's backend. The exact one needs no tiles: a pixel's neighbours give the same."""
    if config.backend.lower() == "exact":
        return stencils.qhed(pixels)
    tiles = tiling.split(pixels, config.tile_size)
    if config.executor is ExecutorKind.SERIAL or config.workers:
        tiles = tiles.coalesce(1 if config.executor is ExecutorKind.SERIAL else config.workers)
    cores = backends.run_tiles(tiles, config.tile_size, backends.get(config.backend, config), config.batch_size)
    return tiling.stitch(cores, config.tile_size)


def watched(df: DataFrame, progress: Callable[[int], None], name: str = "progress") -> DataFrame:
    """``df``; when an action over it has ended, ``progress`` is called with the number of rows that passed here."""
    seen = Observation(name)
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def wait() -> None:
        progress(seen.get["rows"])

    threading.Thread(target=wait, daemon=True).start()
    return out


def run(pixels: DataFrame, height: int, width: int, config: EdgeConfig | None = None) -> DataFrame:
    """(image_id, h, w, y, x, m, e): normalised edges and whether they reach the threshold."""
    scaled, _, _, config = preprocess(pixels, height, width, config or EdgeConfig())
    edges = post.normalise(magnitudes(scaled, config))
    return edges.select(*stencils.KEYS, "m", post.over_pipeline(F.col("m"), config.threshold).alias("e"))


def detect(pixels: DataFrame, method: str, config: EdgeConfig) -> DataFrame:
    """The same for any method, at full size."""
    if method == "qhed":
        m, over = post.normalise(magnitudes(pixels, config)), post.over_pipeline
    elif method == "canny":
        m, over = canny.detect(pixels), post.over_classical
    elif method in stencils.DETECTORS:
        m, over = post.normalise(stencils.DETECTORS[method](pixels)), post.over_classical
    else:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return m.select(*stencils.KEYS, "m", over(F.col("m"), config.threshold).alias("e"))


def score(detected: DataFrame, reference: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """ssim, psnr, precision, recall, f1, iou and edge_density by image_id; reference has ``e``."""
    truth = reference.select("image_id", "h", "w", "y", "x", F.col("e").cast("double").alias("m"))
    pairs = metrics.aligned(detected, truth, "m")
    parts = (metrics.ssim(pairs), metrics.psnr(pairs), metrics.edge_scores(detected, reference, tolerance), metrics.iou(detected, reference), metrics.edge_density(detected))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "image_id")
    return out


def benchmark(pixels: DataFrame, height: int, width: int, reference: DataFrame | None = None, methods: tuple[str, ...] = METHODS, config: EdgeConfig | None = None) -> DataFrame:
    """One row for each method (and image): COLUMNS, with image_id. Without a reference, Canny's edges are it.

    Each method's edges are written once to the shared folder, which is what is timed, and read from there to be scored in one job
    over (image, method). Memory peaks are Spark's affair and null.
    """
    config = (config or EdgeConfig()).with_updates(preset=Preset.FULL_4K)
    spark = pixels.sparkSession
    reference = canny.detect(pixels).withColumn("e", F.col("m") > 0) if reference is None else reference
    tag = lambda df, method: df.withColumn("image_id", F.concat(F.lit(method + "\n"), "image_id"))
    found = truth = None
    times = []
    for method in methods:
        began = time.perf_counter()
        edges = scratch.written(detect(pixels, method, config), f"edges-{method}")
        times.append((method, time.perf_counter() - began, tiling.grid(height, width, config.tile_size)["num_tiles"] if method == "qhed" else None))
        found = tag(edges, method) if found is None else found.unionByName(tag(edges, method))
        truth = tag(reference, method) if truth is None else truth.unionByName(tag(reference, method))
    timed = spark.createDataFrame(times, "method string, runtime_s double, tiles int")
    scored = score(found, truth).withColumn("method", F.split("image_id", "\n")[0]).withColumn("image_id", F.split("image_id", "\n")[1])
    out = scored.join(F.broadcast(timed), "method")
    return out.withColumns({
        "tiles_per_s": F.col("tiles") / F.col("runtime_s"),
        "megapixels_per_s": metrics.throughput(F.lit(height * width / 1e6), F.col("runtime_s")),
        "peak_mem_mb": F.lit(None).cast("double"),
    }).select("image_id", *COLUMNS)


def scaling(spark: SparkSession, sizes: tuple[tuple[int, int], ...], methods: tuple[str, ...] = ("qhed", "sobel", "canny"), config: EdgeConfig | None = None) -> DataFrame:
    """Benchmarks of the scene at several sizes, one below the other."""
    from ..sources import synthetic

    out = None
    for h, w in sizes:
        s = synthetic.scene(spark, h, w)
        rows = benchmark(s.select("image_id", "h", "w", "y", "x", "v"), h, w, stencils.label_edges(s), methods, config)
        rows = rows.select(F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(h * w / 1e6).alias("megapixels"), *COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """The fastest method, the one of best F1 (the first in ``place`` of equals), the quantum one's figures, and the number of methods."""
    rows = rows.withColumn("worst", -F.col("f1"))
    quantum = lambda c: F.max(F.when(F.col("method") == "qhed", F.col(c)))
    return rows.agg(
        F.expr("min_by(method, struct(runtime_s, place)) filter (where runtime_s is not null)").alias("fastest_method"),
        F.min("runtime_s").alias("fastest_runtime_s"),
        F.expr("min_by(method, struct(worst, place)) filter (where f1 is not null)").alias("highest_f1_method"),
        F.max("f1").alias("highest_f1_score"),
        quantum("runtime_s").alias("qhed_runtime_s"),
        quantum("f1").alias("qhed_f1"),
        quantum("megapixels_per_s").alias("qhed_mp_s"),
        F.count(F.lit(1)).alias("total_methods"),
    )


def records(rows: DataFrame) -> DataFrame:
    """One JSON object for each row: no NaN, and ±999 for infinities."""
    def plain(name: str, kind: str):
        c = F.col(name)
        if kind not in ("double", "float"):
            return c
        return F.when(F.isnan(c), None).when(c == float("inf"), 999.0).when(c == float("-inf"), -999.0).otherwise(c).alias(name)

    return rows.select(F.to_json(F.struct(*[plain(n, k) for n, k in rows.dtypes]), {"ignoreNullFields": "false"}).alias("record"))
