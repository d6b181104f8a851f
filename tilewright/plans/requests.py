"""Requests of a client, answered as plain dictionaries: one image each, so that what is collected is bounded by the limits of an upload."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..config import EdgeConfig, Preset, request_config
from ..functions import arrays
from ..operators import backends, canny, circuit, post, stencils, tiling
from ..sources import images, png, results, synthetic
from . import detection

#: Resolutions of a sweep; a quick one leaves the last out.
SWEEP = ((270, 480), (540, 960), (1080, 1920), (2160, 3840))
PIXELS = ("image_id", "h", "w", "y", "x", "v")


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r.record) for r in detection.records(df).collect()]


def _url(pixels: DataFrame, value: str) -> str:
    return images.to_png(pixels, value).select(images.data_url(F.col("content")).alias("url")).first().url


def _uploaded(spark: SparkSession, payload: str) -> tuple[DataFrame, int, int]:
    """(pixels, height, width) of a base64 string or data URL; raises what validation finds."""
    files = spark.createDataFrame([("upload", payload)], "image_id string, payload string").select("image_id", images.content_of(F.col("payload")).alias("content"))
    checked = images.validate(files).first()
    if checked.error:
        raise ValueError(checked.error)
    pixels = scratch.written(images.decode(files), "upload")
    size = pixels.first()
    return pixels, size.h, size.w


def _config(payload: dict) -> EdgeConfig:
    return request_config(payload).with_updates(preset=Preset.FULL_4K)


def capabilities(spark: SparkSession, payload: dict) -> dict:
    return {"status": "success", "backends": [{"name": n, "usable": ok, "reason": why} for n, ok, why in backends.capabilities()]}


def baselines(spark: SparkSession, payload: dict) -> dict:
    """The stored results."""
    return {"status": "success", "sample": _rows(results.sample(spark)), "full_hd": _rows(results.full_hd(spark)), "sweep": _rows(results.sweep(spark)), "circuit": dict(results.CIRCUIT)}


def tile_stages(pixels: DataFrame, threshold: float) -> dict:
    """The first 8 x 8 pixels after each step, as data URLs, and the figures of the tile's circuit."""
    tile = post.crop(pixels).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda z: z["v"]).alias("px"))
    c = F.col("c")
    steps = tile.withColumn("c", post.tile_normalised(F.col("px"))).select(
        F.col("px").alias("original"), c.alias("normalised"), arrays.amplitudes(c)["amps"].alias("amplitudes"),
        arrays.core(c, 8, lambda p, r, d: F.abs(p - r)).alias("across"), arrays.core(c, 8, lambda p, r, d: F.abs(p - d)).alias("down"), arrays.magnitude(c, 8).alias("magnitude"),
    ).withColumn("edges", F.transform("magnitude", lambda m: (m >= threshold).cast("double")))
    found = steps.first().asDict()
    return {name: _tile_url(values) for name, values in found.items()} | {"circuit": circuit.metrics(6)}


def _tile_url(values: list[float]) -> str:
    import base64

    import numpy as np

    side = 8 if len(values) == 64 else 7
    return "data:image/png;base64," + base64.b64encode(png.encode(png.levels(np.array(values).reshape(side, side)))).decode()


def process(spark: SparkSession, payload: dict) -> dict:
    """Edges of an uploaded image by the chosen backend, beside Sobel's and Canny's."""
    began = time.perf_counter()
    config = _config(payload)
    pixels, h, w = _uploaded(spark, str(payload.get("image_b64") or ""))
    scaled, h, w, used = detection.preprocess(pixels, h, w, config)
    loaded = time.perf_counter()
    edges = scratch.written(post.normalise(detection.magnitudes(scaled, used)), "edges")
    ended = time.perf_counter()
    grid = tiling.grid(h, w, used.tile_size)
    figures = circuit.metrics(grid["num_qubits"] - 1)
    return {
        "status": "success",
        "qhed": _url(edges, "m"), "sobel": _url(post.normalise(stencils.sobel(scaled)), "m"), "canny": _url(canny.detect(scaled), "m"), "original": _url(scaled, "v"),
        "timings": {"preprocess": loaded - began, "execution": ended - loaded, "total": time.perf_counter() - began},
        "metadata": {"qubits": figures["num_qubits"], "depth": figures["depth"], "gates": figures["gate_count"], "tiles": grid["num_tiles"], "width": w, "height": h, "backend": used.backend},
        "tile_stages": tile_stages(scaled, used.threshold),
    }


def benchmark(spark: SparkSession, payload: dict) -> dict:
    """All methods, or those asked for, on an upload against Canny, or else on the scene against its boundaries."""
    config = _config(payload)
    if payload.get("image_b64") and not payload.get("use_synthetic"):
        pixels, h, w = _uploaded(spark, str(payload["image_b64"]))
        reference, against = None, "canny"
    else:
        h, w = int(payload.get("height", 540)), int(payload.get("width", 960))
        scene = synthetic.scene(spark, h, w)
        pixels, reference, against = scene.select(*PIXELS), stencils.label_edges(scene), "truth"
    methods = tuple(payload.get("methods") or detection.METHODS)
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    rows = scratch.written(detection.benchmark(pixels, h, w, reference, methods, config).withColumn("place", place), "benchmark")
    known = F.create_map(*[F.lit(x) for m, names in results.LABELS.items() for x in (m, F.struct(F.lit(names[0]).alias("label"), F.lit(names[1]).alias("type")))])
    found = F.try_element_at(known, F.col("method"))
    labelled = rows.withColumns({
        "label": F.coalesce(found["label"], F.initcap("method")), "type": F.coalesce(found["type"], F.lit("Classical")), "runtime_ms": F.round(F.col("runtime_s") * 1000, 2),
        "qubits": F.when(F.col("method") == "qhed", tiling.grid(h, w, config.tile_size)["num_qubits"]),
    })
    return {"status": "success", "results": _rows(labelled.orderBy("place").drop("place", "image_id")), "summary": _rows(detection.summary(rows))[0], "dimensions": {"width": w, "height": h}, "reference": against}


def scaling(spark: SparkSession, payload: dict) -> dict:
    """Records of a sweep, and a row for each resolution."""
    sizes = tuple(map(tuple, payload.get("sizes") or SWEEP[: 3 if payload.get("quick") else 4]))
    methods = tuple(payload.get("methods") or ("qhed", "sobel", "canny"))
    rows = scratch.written(detection.scaling(spark, sizes, methods), "sweep")
    pivot = rows.groupBy("width", "height", "megapixels").pivot("method", list(methods)).agg(F.first("runtime_s").alias("runtime_s"), F.first("megapixels_per_s").alias("mp_s"))
    pivot = pivot.withColumn("resolution", F.concat_ws("x", "width", "height")).orderBy("megapixels")
    return {"status": "success", "sweep_records": _rows(rows), "pivot_rows": _rows(pivot)}


ROUTES: dict[tuple[str, str], Callable[[SparkSession, dict], dict]] = {
    ("GET", "/api/capabilities"): capabilities, ("GET", "/api/benchmark"): baselines, ("GET", "/api/benchmarks_baseline"): baselines,
    ("POST", "/api/process"): process, ("POST", "/api/benchmark"): benchmark, ("POST", "/api/scaling"): scaling,
}


def answer(spark: SparkSession, verb: str, route: str, body: str | bytes | None = None) -> tuple[int, str]:
    """(status, JSON): 200 with the result, 404 for an unknown route, 500 with the message of what went wrong."""
    handler = ROUTES.get((verb.upper(), route))
    if handler is None:
        return 404, ""
    try:
        return 200, json.dumps(handler(spark, json.loads(body) if body else {}))
    except Exception as e:  # whatever it is, the client is told
        return 500, json.dumps({"status": "error", "message": str(e)})
