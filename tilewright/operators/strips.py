"""Large images as strips of rows: one row of binary doubles for each strip and the lines around it that a detector needs.

A strip is all that its part of the result needs, so an image of any size is spread over the cluster without a
shuffle; only small figures cross strips: peaks, counts of levels, and for Canny which border pixels are reached.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..sources import synthetic
from . import canny

SCHEMA = "image_id string, h int, w int, y0 int, n int, up int, data binary"
_NAMES = ["image_id", "h", "w", "y0", "n", "up", "data"]
_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
#: Lines around a strip that any of the detectors needs.
HALO = 3


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _TYPES, strict=True)], _NAMES)


def _scene_rows(h: int, w: int, begin: int, end: int) -> np.ndarray:
    """Lines begin to end of the scene, in numpy."""
    u, v = np.arange(w) / w, np.arange(begin, end) / h
    out = np.full((end - begin, w), synthetic.INTENSITIES[0])
    d, t = synthetic.DISC, synthetic.TRIANGLE

    def box(shape, value: float) -> None:
        rows, columns = (np.flatnonzero((c > shape[k][0]) & (c < shape[k][1])) for k, c in (("v", v), ("u", u)))
        if len(rows) and len(columns):
            out[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] = value

    box(synthetic.RECTANGLE, synthetic.INTENSITIES[1])
    dx, dy = u - d["u"], (v - d["v"]) * h / w
    dx, dy = dx * dx, dy * dy
    near = np.flatnonzero(dy < d["radius"] * d["radius"])
    if len(near):
        rows = slice(near[0], near[-1] + 1)
        out[rows][dx[None, :] + dy[rows, None] < d["radius"] * d["radius"]] = synthetic.INTENSITIES[2]
    within = np.flatnonzero((v > t["v"][0]) & (v < t["v"][1]))
    if len(within):
        rows = slice(within[0], within[-1] + 1)
        out[rows][np.abs(u - t["axis"])[None, :] < ((v[rows] - t["v"][0]) * t["slope"])[:, None]] = synthetic.INTENSITIES[3]
    box(synthetic.SQUARE, synthetic.INTENSITIES[4])
    return out


def scene(spark: SparkSession, h: int, w: int, rows: int = 128, image_id: str = "scene", halo: int = 1) -> DataFrame:
    """The scene in strips."""
    count = -(-h // rows)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y0 = k * rows
                n, begin = min(rows, h - y0), max(0, y0 - halo)
                yield _row(image_id, h, w, y0, n, y0 - begin, _scene_rows(h, w, begin, min(h, y0 + n + halo)).tobytes())

    tasks = min(count, max(1, spark.sparkContext.defaultParallelism))
    return spark.range(0, count, 1, tasks).mapInArrow(run, SCHEMA)


def from_lines(pixels: DataFrame, rows: int = 128, halo: int = 1) -> DataFrame:
    """Strips of pixels: lines first, then lines to the strips that need them; two small groupings. ``halo`` is at most ``rows``."""
    if not 0 <= halo <= rows:
        raise ValueError("a strip needs as many rows as its halo at least")
    lines = pixels.groupBy("image_id", "h", "w", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda z: z["v"]).alias("line"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("y") - halo) / rows)), F.least(F.floor((F.col("h") - 1) / rows), F.floor((F.col("y") + halo) / rows))
    dealt = lines.withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def run(table):
        table = table.sort_by("y")
        image_id, h, w, k, top = (table[c][0].as_py() for c in ("image_id", "h", "w", "k", "y"))
        data = np.array(table["line"].to_pylist(), dtype=np.float64).tobytes()
        return pa.Table.from_batches([_row(image_id, h, w, k * rows, min(rows, h - k * rows), k * rows - top, data)])

    return dealt.groupBy("image_id", "k").applyInArrow(run, SCHEMA)


def _lines(data: bytes, w: int, n: int, up: int, above: int, below: int) -> np.ndarray:
    """The strip's n lines with so many above and below; beyond the image its first or last line is repeated."""
    v = np.frombuffer(data, dtype=np.float64).reshape(-1, w)
    down = len(v) - up - n
    v = v[max(0, up - above) : up + n + min(down, below)]
    more = max(0, above - up), max(0, below - down)
    return np.pad(v, (more, (0, 0)), mode="edge") if any(more) else v


def _qhed(v: np.ndarray) -> np.ndarray:
    """v: n + 1 lines."""
    m = v[:-1] - v[1:]
    m *= m
    h = v[:-1, :-1] - v[:-1, 1:]
    h *= h
    m[:, :-1] += h
    return np.sqrt(m, out=m)


def _two_passes(smooth: float) -> Callable[[np.ndarray], np.ndarray]:
    def run(v: np.ndarray) -> np.ndarray:
        """v: n + 2 lines."""
        p = np.pad(v, ((0, 0), (1, 1)), mode="edge")
        d, s = p[:, 2:] - p[:, :-2], p[:, :-2] + smooth * v + p[:, 2:]
        gx, gy = d[:-2] + smooth * d[1:-1] + d[2:], s[2:] - s[:-2]
        return np.sqrt(gx * gx + gy * gy)

    return run


def _laplacian(v: np.ndarray) -> np.ndarray:
    p = np.pad(v, ((0, 0), (1, 1)), mode="edge")
    e = p[:, :-2] + p[:, 2:]
    return np.abs(2.0 * (e[:-2] + e[2:]) - 8.0 * v[1:-1])


#: Lines above and below that a detector needs, and the detector on them.
DETECTORS: dict[str, tuple[int, int, Callable[[np.ndarray], np.ndarray]]] = {"qhed": (0, 1, _qhed), "sobel": (1, 1, _two_passes(2.0)), "prewitt": (1, 1, _two_passes(1.0)), "laplacian": (1, 1, _laplacian)}


def _each(batches):
    for batch in batches:
        data = batch.column(6)
        heads = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
        for k, head in enumerate(heads):
            yield head, data[k].as_buffer()


def magnitudes(strips: DataFrame, method: str = "qhed") -> DataFrame:
    """Strips of magnitudes by ``method``, without lines around them, each with its ``peak``."""
    above, below, detector = DETECTORS[method]

    def run(batches):
        for (image_id, h, w, y0, n, up), data in _each(batches):
            m = detector(_lines(data, w, n, up, above, below))
            yield pa.RecordBatch.from_arrays([*_row(image_id, h, w, y0, n, 0, m.tobytes()).columns, pa.array([float(m.max(initial=0.0))])], [*_NAMES, "peak"])

    return strips.mapInArrow(run, SCHEMA + ", peak double")


def qhed(strips: DataFrame) -> DataFrame:
    """Strips of edge magnitudes, each with its ``peak``."""
    return magnitudes(strips, "qhed")


def edge_counts(magnitudes: DataFrame, threshold: float) -> DataFrame:
    """(image_id, peak, n_edges) of strips of magnitudes: pixels of at least ``threshold`` of their image's peak."""
    return _counted(magnitudes, threshold, 0, 0, lambda m: m)


def detected_counts(strips: DataFrame, threshold: float, method: str = "qhed") -> DataFrame:
    """The same of strips of an image, by ``method``, in one map: magnitudes don't leave it."""
    return _counted(strips, threshold, *DETECTORS[method])


def _counted(strips: DataFrame, threshold: float, above: int, below: int, detector: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One pass: a strip gives its peak and its values that may reach the image's, sorted, with their numbers. Those go
    through one exchange that both the peaks and the counts read."""

    def run(batches):
        for (image_id, _, w, y0, n, up), data in _each(batches):
            m = detector(_lines(data, w, n, up, above, below)).reshape(-1)
            top = float(m.max(initial=0.0))
            values, counts = np.unique(m[m >= max(threshold * top, 1e-12)], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([image_id], pa.string()), pa.array([y0], pa.int32()), pa.array([top], pa.float64()), pa.array([values.tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], ["image_id", "y0", "peak", "values", "counts"]
            )

    def count(batches):
        for batch in batches:
            n = []
            for top, values, counts in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                v, c = np.frombuffer(values.as_buffer(), dtype=np.float64), np.frombuffer(counts.as_buffer(), dtype=np.int64)
                n.append(int(c[np.searchsorted(v, max(threshold * top, 1e-12)) :].sum()) if top > 1e-9 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["image_id", "peak", "n"])

    found = strips.mapInArrow(run, "image_id string, y0 int, peak double, values binary, counts binary").where("image_id is not null and y0 is not null and peak is not null").repartition("image_id", "y0")
    # A row for each image; reading all columns keeps the exchange the same on both sides.
    peaks = found.groupBy("image_id").agg(F.max("peak").alias("top"), F.max(F.length("values") + F.length("counts") + F.col("y0")).alias("used"))
    joined = found.join(F.broadcast(peaks), "image_id").where("used >= 0 and peak <= top").select("image_id", "top", "values", "counts")
    return joined.mapInArrow(count, "image_id string, peak double, n long").groupBy("image_id", "peak").agg(F.sum("n").alias("n_edges"))


def to_pixels(strips: DataFrame, column: str = "m") -> DataFrame:
    """pixels(image_id, h, w, y, x, m)."""

    def run(batches):
        for (image_id, h, w, y0, n, up), data in _each(batches):
            v = _lines(data, w, n, up, 0, 0).reshape(-1)
            y, x = np.divmod(np.arange(n * w, dtype=np.int32), np.int32(w))
            full = lambda c: pa.array(np.full(n * w, c, np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([image_id] * (n * w), pa.string()), full(h), full(w), pa.array(y + np.int32(y0)), pa.array(x), pa.array(v)], ["image_id", "h", "w", "y", "x", column])

    return strips.select(*_NAMES).mapInArrow(run, f"image_id string, h int, w int, y int, x int, {column} double")


# ---------------------------------------------------------------- Canny

_BITS = "image_id string, h int, w int, y0 int, n int, found binary, weak binary, open long"


def _bits(image_id, h, w, y0, n, found: np.ndarray, weak: np.ndarray) -> pa.RecordBatch:
    heads = [pa.array([x], t) for x, t in zip((image_id, h, w, y0, n), _TYPES, strict=False)]
    masks = [pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (found, weak)]
    return pa.RecordBatch.from_arrays([*heads, *masks, pa.array([int(weak.sum())], pa.int64())], ["image_id", "h", "w", "y0", "n", "found", "weak", "open"])


def _unpacked(data: bytes, n: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n * w).reshape(n, w).astype(bool)


def _thinned(strips: DataFrame, low: float | None, high: float | None, blur: int) -> DataFrame:
    """Strips of two bit masks: pixels above the upper threshold, and thin ones above the lower that may be joined to them."""
    if blur > 3:
        raise ValueError("strips have lines enough for a blur of 3")
    r = blur // 2 if blur > 1 else 0

    def levels(data, w, h, y0, n, up, around):
        """Blurred levels of the strip and so many lines around it, and how many stand above; the image's own border isn't crossed."""
        v = np.frombuffer(data, dtype=np.float64).reshape(-1, w)
        begin, end = max(0, y0 - around), min(h, y0 + n + around)
        first = y0 - up
        inside = v[max(0, begin - r) - first : min(h, end + r) - first]
        out = canny.blurred(canny.byte_levels(inside), blur, top=begin - r >= 0 or not r, bottom=end + r <= h or not r)
        return out[: end - begin], y0 - begin

    def tally(batches):
        for (image_id, h, w, y0, n, up), data in _each(batches):
            own, _ = levels(data, w, h, y0, n, up, 0)
            c = np.bincount(own.reshape(-1), minlength=256)
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(c[seen], pa.int64())], ["image_id", "level", "c"])

    def thin(batches):
        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5, 7, 8)), strict=True)
            for k, (image_id, h, w, y0, n, up, lo, hi) in enumerate(heads):
                lines, above = levels(batch.column(6)[k].as_buffer(), w, h, y0, n, up, 2)
                strong, thin = canny.thinned(lines, lo, hi)
                strong, thin = strong[above : above + n], thin[above : above + n]
                yield _bits(image_id, h, w, y0, n, strong, thin & ~strong)

    counted = strips.mapInArrow(tally, "image_id string, level int, c long").groupBy("image_id", "level").agg(F.sum("c").alias("c"))
    # 256 levels an image at most.
    cuts = canny.thresholds_of(counted, low, high)
    return strips.join(F.broadcast(cuts), "image_id").select(*_NAMES, "low", "high").mapInArrow(thin, _BITS)


def _flooded(state: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """``state`` after each strip's found pixels, and its weak ones at ``seeds`` (image_id, y0, line, xs), have spread."""

    def run(batches):
        for batch in batches:
            for image_id, h, w, y0, n, found, weak, seeded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, weak = _unpacked(found, n, w), _unpacked(weak, n, w)
                for s in seeded or ():
                    xs = np.frombuffer(s["xs"], np.int32)
                    near = np.unique((xs[:, None] + np.array([-1, 0, 1], np.int32)).reshape(-1))
                    near = near[(near >= 0) & (near < w)]
                    found[s["line"], near[weak[s["line"], near]]] = True
                out = canny.spread(found, weak & ~found)
                yield _bits(image_id, h, w, y0, n, out, weak & ~out)

    state = state.drop("open")
    if seeds is None:
        state = state.withColumn("seeds", F.lit(None).cast("array<struct<line:int,xs:binary>>"))
    else:
        own = seeds.groupBy("image_id", "y0").agg(F.collect_list(F.struct("line", "xs")).alias("seeds"))  # two lines a strip at most
        state = state.join(own, ["image_id", "y0"], "left").select("image_id", "h", "w", "y0", "n", "found", "weak", "seeds")
    return state.mapInArrow(run, _BITS)


def _borders(state: DataFrame) -> DataFrame:
    """(image_id, y0, line, xs) for the neighbours of each strip: where its first and last lines are found."""

    def run(batches):
        for batch in batches:
            for image_id, h, w, y0, n, rows, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = _unpacked(found, n, w)
                to = ([(y0 - rows, rows - 1, v[0])] if y0 else []) + ([(y0 + n, 0, v[-1])] if y0 + n < h else [])
                to = [(a, b, np.flatnonzero(x).astype(np.int32)) for a, b, x in to if x.any()]
                yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(to), pa.string()), pa.array([t[0] for t in to], pa.int32()), pa.array([t[1] for t in to], pa.int32()), pa.array([t[2].tobytes() for t in to], pa.binary())], ["image_id", "y0", "line", "xs"])

    # All strips of an image but the last have as many rows.
    rows = state.groupBy("image_id").agg(F.max("n").alias("rows"))
    return state.join(F.broadcast(rows), "image_id").select("image_id", "h", "w", "y0", "n", "rows", "found").mapInArrow(run, "image_id string, y0 int, line int, xs binary")


def canny_masks(strips: DataFrame, low: float | None = None, high: float | None = None, blur: int = 3) -> DataFrame:
    """Strips (with HALO lines around them, blur at most 3) of Canny's mask: (image_id, h, w, y0, n, found, weak), bits.

    Pixels spread within strips first; what they reach on a strip's border goes to its neighbours, until
    nothing new is found. Only border lines cross strips. Each round's masks, two bits a pixel, are written to the
    shared folder.
    """
    still_open = lambda df: df.agg(F.sum("open")).first()[0] or 0
    state = scratch.written(_flooded(_thinned(strips, low, high, blur), None), "canny-masks")
    before = still_open(state)
    while before:
        after = scratch.written(_flooded(state, _borders(state)), "canny-masks")
        scratch.discard(state)
        state, now = after, still_open(after)
        if now == before:
            break
        before = now
    return state


def canny_pixels(masks: DataFrame) -> DataFrame:
    """pixels(image_id, h, w, y, x, m) of ``canny_masks``, m 0 or 1."""

    def run(batches):
        for batch in batches:
            for image_id, h, w, y0, n, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _row(image_id, h, w, y0, n, 0, _unpacked(found, n, w).astype(np.float64).tobytes())

    return to_pixels(masks.select("image_id", "h", "w", "y0", "n", "found").mapInArrow(run, SCHEMA))


def canny_counts(masks: DataFrame) -> DataFrame:
    """(image_id, n_edges) of ``canny_masks``."""

    def run(batches):
        for batch in batches:
            n = [int(np.bitwise_count(np.frombuffer(b.as_buffer(), np.uint8)).sum()) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["image_id", "n"])

    return masks.select("image_id", "found").mapInArrow(run, "image_id string, n long").groupBy("image_id").agg(F.sum("n").alias("n_edges"))
