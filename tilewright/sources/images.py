"""Image files to pixels or strips: validation with an error column, decoding in Arrow batches, and PNG sinks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resample
from . import jpeg, png, synthetic

#: Limits of an upload.
MAX_BYTES, MAX_LONG, MAX_SHORT, MIN_SIDE = 50 * 1024 * 1024, 3840, 2160, 2
PREVIEW_SIDE = 1024
#: Pixels from which on a file isn't opened at all: a small one may claim any size.
BOMB = 178_956_970


def probe(data: bytes) -> tuple[str, int, int]:
    """(format, width, height); raises for what isn't an image that is known."""
    if data[:8] == png.SIGNATURE:
        w, h, *_ = png.header(data)
        return "PNG", w, h
    if data[:2] == b"\xff\xd8":
        return ("JPEG", *jpeg.size(data))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("GIF", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    raise png.ImageError("not an image")


def check(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """(format, width, height, error): the first rule that fails names the error."""
    if not data:
        return None, None, None, "empty file"
    if len(data) > MAX_BYTES:
        return None, None, None, "file larger than 50 MiB"
    try:
        kind, w, h = probe(data)
    except (png.ImageError, struct.error, IndexError):
        return None, None, None, "not a readable PNG or JPEG image"
    if w * h > BOMB:
        return kind, w, h, "too many pixels"
    if kind not in ("PNG", "JPEG"):
        return kind, w, h, f"unsupported format {kind}"
    if max(w, h) > MAX_LONG or min(w, h) > MAX_SHORT:
        return kind, w, h, "larger than 3840x2160"
    if min(w, h) < MIN_SIDE:
        return kind, w, h, "smaller than 2 pixels"
    try:
        grey(data)
    except (png.ImageError, struct.error, ValueError, IndexError):
        return kind, w, h, "truncated or damaged"
    return kind, w, h, None


def orientation(data: bytes) -> int:
    """The orientation tag of a PNG or JPEG, 1 to 8."""
    if data[:8] == png.SIGNATURE:
        return jpeg.exif_orientation(png.exif(data))
    return jpeg.orientation(data)


def upright(v: np.ndarray, tag: int) -> np.ndarray:
    """The image as its orientation tag means it to be seen: a turn by quarters, clockwise, then a flip."""
    turns, flipped = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (1, False), 7: (3, True), 8: (3, False)}[tag]
    v = np.rot90(v, -turns)
    return v[:, ::-1] if flipped else v


def grey(data: bytes) -> np.ndarray:
    """Intensities in [0, 1] of a PNG or JPEG, upright."""
    v = png.grey(data) if data[:8] == png.SIGNATURE else png.intensities(jpeg.decode(data), 255)
    return np.ascontiguousarray(upright(v, orientation(data)))


def validate(files: DataFrame) -> DataFrame:
    """``files`` (image_id, content) with format, width, height and error (null: accepted)."""

    def run(batches):
        for batch in batches:
            rows = [check(c) for c in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["image_id", "format", "width", "height", "error"])

    return files.select("image_id", "content").mapInArrow(run, "image_id string, format string, width int, height int, error string")


def content_of(payload: Column) -> Column:
    """Bytes of a base64 string or data URL."""
    return F.unbase64(F.when(payload.startswith("data:image"), F.substring_index(payload, ",", -1)).otherwise(payload))


def decode(files: DataFrame) -> DataFrame:
    """pixels(image_id, h, w, y, x, v) of PNG and JPEG files (image_id, content), upright; a file that can't be decoded raises (validate first)."""

    def run(batches):
        for batch in batches:
            for image_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = grey(content)
                h, w = v.shape
                for y in range(0, h, 256):  # bands, so that a large image isn't one batch
                    band = v[y : y + 256]
                    n = band.size
                    ys, xs = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image_id] * n), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), pa.array(ys + np.int32(y)), pa.array(xs), pa.array(band.reshape(-1))], ["image_id", "h", "w", "y", "x", "v"]
                    )

    return files.select("image_id", "content").mapInArrow(run, "image_id string, h int, w int, y int, x int, v double")


def sample_or_scene(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Pixels of the image file at ``path``; without one, or where there is none, the scene at 540 x 960."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return decode(read(spark, path))
    return synthetic.scene(spark, 540, 960).select("image_id", "h", "w", "y", "x", "v")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, content) of the files under ``path``; image_id is the file's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("image_id"), "content")


def read_8bit(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of 8-bit files that Spark's image source reads on the JVM, as luma of its BGR bytes, orientation ignored; unreadable files are left out."""
    found = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    n = F.col("nChannels")
    rows = found.select(F.element_at(F.split("origin", "/"), -1).alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"), n.alias("n"), "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    line = rows.select("image_id", "h", "w", "n", "y", F.substring(F.col("data"), F.col("y") * F.col("w") * F.col("n") + 1, F.col("w") * F.col("n")).alias("line"))
    cells = line.select("image_id", "h", "w", "n", "y", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    at = lambda k: F.conv(F.hex(F.substring(F.col("line"), F.col("x") * F.col("n") + 1 + k, F.lit(1))), 16, 10).cast("int")
    grey = F.when(F.col("n") == 1, at(0)).otherwise(F.round(0.114 * at(0) + 0.587 * at(1) + 0.299 * at(2)))
    return cells.select("image_id", "h", "w", "y", "x", (grey / 255.0).alias("v"))


def grey_of(r: Column, g: Column, b: Column, top: Column | int) -> Column:
    """Unquantised luma of integer channels, clipped to [0, 1]."""
    v = (0.299 * r + 0.587 * g + 0.114 * b) / top
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _files(images: DataFrame, value: str, encode) -> DataFrame:
    """(image_id, content): ``encode`` of each image's byte levels; rows are packed first, so a group is a row for each line."""
    lines = images.groupBy("image_id", "h", "w", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))), lambda z: z["v"]).alias("line"))

    def run(key, table):
        table = table.sort_by("y")
        v = np.array(table["line"].to_pylist(), dtype=np.float64)
        return pa.table({"image_id": [key[0].as_py()], "content": pa.array([encode(png.levels(v))], pa.binary())})

    return lines.groupBy("image_id").applyInArrow(run, "image_id string, content binary")


def to_png(images: DataFrame, value: str = "m", orientation: int | None = None) -> DataFrame:
    """(image_id, content): an 8-bit PNG of each image's pixels."""
    return _files(images, value, lambda levels: png.encode(levels, orientation))


def to_jpeg(images: DataFrame, value: str = "m", quantiser: int = 1, orientation: int | None = None) -> DataFrame:
    """(image_id, content): a grey JPEG of each image's pixels."""
    return _files(images, value, lambda levels: jpeg.encode_grey(levels, quantiser, orientation))


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))


def preview(images: DataFrame, height: int, width: int, value: str = "m", side: int = PREVIEW_SIDE) -> DataFrame:
    """(image_id, h, w, y, x, level): images of one size, scaled down to ``side`` at most, as byte levels."""
    small = resample.resize(images.withColumn("v", F.col(value)), height, width, side, clip=False)
    level = F.floor(F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return small.select("image_id", "h", "w", "y", "x", level.alias("level"))


def write_png(images: DataFrame, path: str, value: str = "m") -> None:
    """One Parquet row of PNG bytes for each image, on any store that Spark writes to."""
    to_png(images, value).write.parquet(path)


def write_png_files(images: DataFrame, folder: str, value: str = "m", suffix: str = "_qhed_edges.png") -> DataFrame:
    """A PNG file for each image in ``folder``, an address that all executors reach; gives (image_id, path, bytes) of what was written.

    The files are written when the result is read. Each is written under another name first, so that a
    task that is run twice leaves whole files. Slashes in an image's id become underscores.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for image_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{base.rstrip('/')}/{str(image_id).rsplit('.', 1)[0].replace('/', '_')}{suffix}"
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, path)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["image_id", "path", "bytes"])

    return to_png(images, value).mapInArrow(run, "image_id string, path string, bytes long")
