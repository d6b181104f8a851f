"""Tiles of T x T pixels with a halo of one, and their cores of (T-1) x (T-1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(height: int, width: int, t: int) -> dict[str, int]:
    """The figures of an image's tile grid."""
    if t < 2 or height < 1 or width < 1:
        raise ValueError("tiles need t >= 2 and an image that isn't empty")
    rows, cols, n = math.ceil(height / (t - 1)), math.ceil(width / (t - 1)), 1 << (t * t - 1).bit_length()
    return {"rows": rows, "cols": cols, "num_tiles": rows * cols, "core_size": t - 1, "halo_size": 1, "padded_vector_length": n, "num_qubits": n.bit_length()}


def grid_columns(h: Column, w: Column, t: int) -> dict[str, Column]:
    """The same as columns."""
    rows, cols, n = F.ceil(h / (t - 1)).cast("int"), F.ceil(w / (t - 1)).cast("int"), 1 << (t * t - 1).bit_length()
    return {"rows": rows, "cols": cols, "num_tiles": rows * cols, "core_size": F.lit(t - 1), "halo_size": F.lit(1), "padded_vector_length": F.lit(n), "num_qubits": F.lit(n.bit_length())}


def _places(at: Column, size: Column, t: int) -> Column:
    """The (tile, place in it) of a row or column: a border of two tiles is in both, the last one fills up the last tile."""
    s = t - 1
    tiles = F.ceil(size / s).cast("int")
    own = F.floor(at / s).cast("int")
    pair = lambda tile, k: F.struct(tile.cast("int").alias("t"), k.cast("int").alias("k"))
    shared = F.when((at % s == 0) & (at > 0), F.array(pair(own - 1, F.lit(s)))).otherwise(F.array().cast("array<struct<t:int,k:int>>"))
    filled = F.transform(F.sequence(size - 1 - (tiles - 1) * s, F.lit(s)), lambda k: pair(tiles - 1, k))
    return F.concat(F.when(at == size - 1, filled).otherwise(F.array(pair(own, at % s))), shared)


def split(pixels: DataFrame, t: int) -> DataFrame:
    """tiles(image_id, h, w, tile_id, px array<double> of T*T): each pixel goes to the tiles it is in; one shuffle, no join."""
    r = pixels.select("image_id", "h", "w", "x", "v", F.explode(_places(F.col("y"), F.col("h"), t)).alias("r"))
    c = r.select("image_id", "h", "w", "v", "r", F.explode(_places(F.col("x"), F.col("w"), t)).alias("c"))
    cells = c.select("image_id", "h", "w", (F.col("r.t") * F.ceil(F.col("w") / (t - 1)).cast("int") + F.col("c.t")).alias("tile_id"), F.struct((F.col("r.k") * t + F.col("c.k")).alias("k"), "v").alias("kv"))
    grouped = cells.groupBy("image_id", "h", "w", "tile_id").agg(F.array_sort(F.collect_list("kv")).alias("kvs"))
    return grouped.select("image_id", "h", "w", "tile_id", F.transform("kvs", lambda z: z["v"]).alias("px"))


def stitch(cores: DataFrame, t: int, column: str = "core") -> DataFrame:
    """Pixels from cores; what was filled up beyond the image goes."""
    s, k = t - 1, F.col("pos")
    cols = F.ceil(F.col("w") / s).cast("int")
    out = cores.select("image_id", "h", "w", "tile_id", F.posexplode(column).alias("pos", "m"))
    out = out.withColumns({"y": (F.floor(F.col("tile_id") / cols) * s + F.floor(k / s)).cast("int"), "x": ((F.col("tile_id") % cols) * s + k % s).cast("int")})
    return out.where((F.col("y") < F.col("h")) & (F.col("x") < F.col("w"))).select("image_id", "h", "w", "y", "x", "m")


def batch(tiles: DataFrame, start: int, stop: int) -> DataFrame:
    """The tiles with start <= tile_id < stop."""
    if not 0 <= start <= stop:
        raise ValueError("0 <= start <= stop is needed")
    return tiles.where((F.col("tile_id") >= start) & (F.col("tile_id") < stop))


def core_of(px: Column, t: int) -> Column:
    """The (T-1) x (T-1) pixels that a tile owns."""
    s = t - 1
    return F.transform(F.sequence(F.lit(0), F.lit(s * s - 1)), lambda i: F.get(px, (F.floor(i / s) * t + i % s).cast("int")))
