"""PNG in numpy and zlib: all colour types and depths, palettes, transparency and interlacing; writing 8-bit grey."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Interlacing passes: first row and column, and their steps.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


class ImageError(ValueError):
    pass


def chunks(data: bytes):
    """(kind, body) of each chunk; raises for a wrong checksum or a truncated file."""
    if data[:8] != SIGNATURE:
        raise ImageError("not a PNG file")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ImageError("truncated")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ImageError("truncated")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ImageError("wrong checksum")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ImageError("truncated")


def header(data: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, depth, colour type, interlaced)."""
    if data[:8] != SIGNATURE or len(data) < 33 or data[12:16] != b"IHDR":
        raise ImageError("not a PNG file")
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if not w or not h or colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ImageError("odd header")
    return w, h, depth, colour, interlaced


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise ImageError("truncated")
    lines = np.frombuffer(raw, dtype=np.uint8, count=rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.uint8)
    for k in range(rows):
        kind, line = int(lines[k, 0]), lines[k, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 2:
            now = line + before
        elif kind == 1:
            padded = np.concatenate([line, np.zeros(-stride % step, dtype=np.uint8)]).reshape(-1, step)
            now = np.cumsum(padded, axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            now, a, b = bytearray(stride), line.tolist(), before.tolist()
            for i in range(stride):
                left = now[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + b[i]) // 2
                else:
                    corner = b[i - step] if i >= step else 0
                    p = left + b[i] - corner
                    pl, pu, pc = abs(p - left), abs(p - b[i]), abs(p - corner)
                    guess = left if pl <= pu and pl <= pc else b[i] if pu <= pc else corner
                now[i] = (a[i] + guess) & 255
            now = np.frombuffer(bytes(now), dtype=np.uint8)
        else:
            raise ImageError("odd filter")
        out[k] = before = now
    return out


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 8:
        flat = lines
    elif depth == 16:
        flat = lines.reshape(len(lines), -1, 2).astype(np.uint16)
        flat = (flat[..., 0] << 8) | flat[..., 1]
    else:
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        flat = ((lines[..., None] >> shifts) & ((1 << depth) - 1)).reshape(len(lines), -1)
    return flat[:, : width * channels].reshape(len(lines), width, channels)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples of shape (h, w, 1 to 4), largest value): grey, grey + alpha, RGB or RGBA; palettes become RGB or RGBA."""
    w, h, depth, colour, interlaced = header(data)
    body, palette, alpha = b"", None, None
    for kind, part in chunks(data):
        if kind == b"IDAT":
            body += part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
    try:
        raw = zlib.decompress(body)
    except zlib.error as e:
        raise ImageError("damaged data") from e
    channels = _CHANNELS[colour]
    bits = depth * channels
    out = np.zeros((h, w, channels), dtype=np.uint16 if depth == 16 else np.uint8)
    at = 0
    for y0, x0, dy, dx in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, cols = len(range(y0, h, dy)), len(range(x0, w, dx))
        if rows and cols:
            stride = (cols * bits + 7) // 8
            out[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], rows, stride, max(1, bits // 8)), cols, depth, channels)
            at += rows * (stride + 1)
    top = (1 << depth) - 1
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ImageError("palette too short")
        index, out, top = out[..., 0], palette[out[..., 0]], 255
        if alpha is not None:
            full = np.full(256, 255, dtype=np.uint8)
            full[: len(alpha)] = np.frombuffer(alpha[:256], dtype=np.uint8)
            out = np.dstack([out, full[index]])
    elif alpha is not None and colour in (0, 2):
        key = np.array(struct.unpack(f">{len(alpha) // 2}H", alpha), dtype=out.dtype)
        clear = (out == key).all(axis=2)
        out = np.dstack([out, np.where(clear, 0, top).astype(out.dtype)])
    return out, top


def exif(data: bytes) -> bytes:
    """The TIFF block of an eXIf chunk; empty where there is none."""
    return next((body for kind, body in chunks(data) if kind == b"eXIf"), b"")


def grey(data: bytes) -> np.ndarray:
    """Intensities in [0, 1] of a PNG."""
    return intensities(*decode(data))


def intensities(samples: np.ndarray, top: int) -> np.ndarray:
    """In [0, 1]. 16-bit grey keeps its depth; all else is composed over white and becomes 8-bit luma first."""
    if top == 65535 and samples.shape[2] == 1:
        return np.clip(samples[..., 0] / 65535.0, 0, 1)
    v = samples.astype(np.float64) * (255.0 / top)
    if top == 65535:
        v = np.floor(v)
    if v.shape[2] in (2, 4):
        a = v[..., -1:] / 255.0
        v = np.rint(v[..., :-1] * a + 255.0 * (1 - a))
    if v.shape[2] == 3:
        # Luma in 16-bit fixed point.
        r, g, b = (v[..., k].astype(np.int64) for k in range(3))
        v = ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16)[..., None].astype(np.float64)
    return v[..., 0] / 255.0


def encode(samples: np.ndarray, orientation: int | None = None) -> bytes:
    """A PNG of samples (h, w) or (h, w, 1 to 4): grey, grey + alpha, RGB or RGBA; 16 bits deep for uint16, else 8. ``orientation`` is its EXIF tag."""
    wide = samples.dtype == np.uint16
    samples = np.ascontiguousarray(samples, dtype=">u2" if wide else np.uint8)
    h, w, channels = *samples.shape[:2], 1 if samples.ndim == 2 else samples.shape[2]
    lines = samples.reshape(h, -1).view(np.uint8)
    raw = np.zeros((h, lines.shape[1] + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    colour = {n: c for c, n in _CHANNELS.items() if c != 3}[channels]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    tag = b"" if orientation is None else chunk(b"eXIf", b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if wide else 8, colour, 0, 0, 0)) + tag + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def levels(v: np.ndarray) -> np.ndarray:
    """Byte levels of intensities, halves up."""
    return (np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)
