"""JPEG in numpy: sequential and progressive Huffman coding of 8-bit samples, with restarts and subsampling; grey fixtures.

The entropy-coded part is read symbol by symbol, all else is vectorised. Chroma at half the width (and height) is
upsampled by weights 3:1 of the nearest samples, at other ratios by repetition; the inverse transform is in floating point, so that
samples may differ by a level or so from a decoder in integers.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np

from .png import ImageError

#: Places of coefficients in the order of the file: diagonal by diagonal, in turns up and down.
ZIGZAG = [y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)]
_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]


def segments(data: bytes):
    """(marker, body, where the body ends) of each segment up to the end of the image."""
    if data[:2] != b"\xff\xd8":
        raise ImageError("not a JPEG file")
    at = 2
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return
        kind = data[at + 1]
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            yield kind, b"", at + 2
            return
        if at + 4 > len(data):
            raise ImageError("truncated")
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if n < 2 or at + 2 + n > len(data):
            raise ImageError("truncated")
        yield kind, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n


def is_frame(kind: int) -> bool:
    return 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)


def size(data: bytes) -> tuple[int, int]:
    """(width, height) from the frame header."""
    for kind, body, _ in segments(data):
        if is_frame(kind) and len(body) >= 6:
            h, w = struct.unpack(">HH", body[1:5])
            return w, h
    raise ImageError("no frame")


def exif_orientation(tiff: bytes) -> int:
    """The orientation tag of a TIFF block, 1 where there is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    count = struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0
    for k in range(count):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "HH", entry[:4]) == (0x0112, 3):
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(data: bytes) -> int:
    for kind, body, _ in segments(data):
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return exif_orientation(body[6:])
        if kind == 0xDA:
            break
    return 1


class _Bits:
    """Bits of one stretch of entropy-coded data between restarts; zeros after its end, up to a limit."""

    __slots__ = ("acc", "at", "data", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def _more(self) -> None:
        part = self.data[self.at : self.at + 8]
        if self.at > len(self.data) + 64:
            raise ImageError("truncated")
        self.acc = ((self.acc & ((1 << self.n) - 1)) << 64) | int.from_bytes(part.ljust(8, b"\0"))
        self.at += 8
        self.n += 64

    def take(self, k: int) -> int:
        if self.n < k:
            self._more()
        self.n -= k
        return (self.acc >> self.n) & ((1 << k) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self._more()
        found = table[(self.acc >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise ImageError("damaged data")
        self.n -= found >> 8
        return found & 255

    def value(self, k: int) -> int:
        """A signed value of ``k`` bits."""
        if not k:
            return 0
        v = self.take(k)
        return v if v >> (k - 1) else v - (1 << k) + 1

    def spent(self) -> bool:
        """Whether more was read than is there."""
        return self.at * 8 - self.n > len(self.data) * 8


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """Length * 256 + symbol for each 16 bits that begin with a code, else 0."""
    out, k = [], 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out += [length << 8 | symbol] * (1 << (16 - length))
        k += n
    if len(out) > 1 << 16:
        raise ImageError("odd table")
    return out + [0] * ((1 << 16) - len(out))


class _Component:
    def __init__(self, key: int, h: int, v: int, quantiser: int):
        self.key, self.h, self.v, self.quantiser = key, h, v, quantiser
        self.dc = self.ac = self.before = 0


class _Scan:
    """Reads the blocks of one scan into the components' coefficients."""

    def __init__(self, bits: _Bits, tables: dict, first: int, last: int, high: int, low: int, progressive: bool):
        self.bits, self.tables, self.first, self.last, self.high, self.low, self.progressive, self.run = bits, tables, first, last, high, low, progressive, 0

    def block(self, c: _Component, at: int) -> None:
        if not self.progressive:
            self._dc(c, at)
            self._ac(c, at, 1, 63, 0)
        elif not self.first:
            if self.high:
                if self.bits.take(1):
                    c.coefficients[at] |= 1 << self.low
            else:
                self._dc(c, at)
        elif self.high:
            self._refine(c, at)
        else:
            self._ac(c, at, self.first, self.last, self.low)

    def _dc(self, c: _Component, at: int) -> None:
        c.before += self.bits.value(self.bits.symbol(self.tables[0, c.dc]) & 15)
        c.coefficients[at] = c.before << self.low

    def _ac(self, c: _Component, at: int, k: int, last: int, low: int) -> None:
        if self.run:
            self.run -= 1
            return
        bits, table, out = self.bits, self.tables[1, c.ac], c.coefficients
        while k <= last:
            found = bits.symbol(table)
            skip, size = found >> 4, found & 15
            if size:
                k += skip
                if k > 63:
                    raise ImageError("damaged data")
                out[at + ZIGZAG[k]] = bits.value(size) << low
                k += 1
            elif skip == 15:
                k += 16
            else:
                self.run = (1 << skip) - 1 + (bits.take(skip) if skip else 0)
                return

    def _refine(self, c: _Component, at: int) -> None:
        bits, table, out, one, k = self.bits, self.tables[1, c.ac], c.coefficients, 1 << self.low, self.first

        def correct(i: int) -> None:
            if bits.take(1) and not abs(out[i]) & one:
                out[i] += one if out[i] > 0 else -one

        if not self.run:
            while k <= self.last:
                found = bits.symbol(table)
                skip, size = found >> 4, found & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif skip < 15:
                    self.run = (1 << skip) + (bits.take(skip) if skip else 0)
                    break
                while k <= self.last:
                    i = at + ZIGZAG[k]
                    k += 1
                    if out[i]:
                        correct(i)
                    elif skip:
                        skip -= 1
                    else:
                        if new:
                            out[i] = new
                        break
        if self.run:
            for j in range(k, self.last + 1):
                i = at + ZIGZAG[j]
                if out[i]:
                    correct(i)
            self.run -= 1


def _stretches(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded data from ``at`` on, cut at restarts, without stuffing."""
    out, begun = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begun:])
            break
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD7:
            out.append(data[begun:at])
            begun = at + 2
        elif kind not in (0x00, 0xFF):
            out.append(data[begun:at])
            break
        at += 1 if kind == 0xFF else 2
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _widened(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """A plane of samples at full size."""
    if across != 2 or down > 2:
        return plane.repeat(down, axis=0).repeat(across, axis=1)
    v = plane.astype(np.int64)
    if down == 2:
        p = np.pad(v, ((1, 1), (0, 0)), mode="edge")
        v = np.stack([3 * v + p[:-2], 3 * v + p[2:]], axis=1).reshape(-1, v.shape[1])
    p = np.pad(v, ((0, 0), (1, 1)), mode="edge")
    left, right, (a, b, shift) = 3 * v + p[:, :-2], 3 * v + p[:, 2:], (8, 7, 4) if down == 2 else (1, 2, 2)
    return np.stack([(left + a) >> shift, (right + b) >> shift], axis=2).reshape(len(v), -1).astype(np.float64)


def decode(data: bytes) -> np.ndarray:
    """Samples (h, w, 1 or 3) of 8 bits: grey or RGB; four inks become RGB. Orientation isn't applied."""
    quantisers, tables, components, interval, adobe, frame, ended = {}, {}, [], 0, None, None, False
    for kind, body, end in segments(data):
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                if len(body) < 1 + n:
                    raise ImageError("truncated")
                q = np.zeros(64)
                q[ZIGZAG] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8)
                quantisers[k], body = q, body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif is_frame(kind):
            if kind not in (0xC0, 0xC1, 0xC2) or body[0] != 8 or frame:
                raise ImageError("unsupported coding")
            h, w = struct.unpack(">HH", body[1:5])
            if not h or not w or body[5] not in (1, 3, 4) or len(body) < 6 + 3 * body[5]:
                raise ImageError("odd frame")
            components = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            across, down = max(c.h for c in components), max(c.v for c in components)
            if not all(c.h and c.v for c in components):
                raise ImageError("odd frame")
            columns, rows = -(-w // (8 * across)), -(-h // (8 * down))
            for c in components:
                c.stride, c.blocks = columns * c.h, (-(-(-(-w * c.h // across)) // 8), -(-(-(-h * c.v // down)) // 8))
                c.coefficients = array("i", bytes(4 * 64 * c.stride * rows * c.v))
            frame = (h, w, kind == 0xC2)
        elif kind == 0xDA:
            if not frame:
                raise ImageError("no frame")
            own = []
            for k in range(body[0]):
                c = next((c for c in components if c.key == body[1 + 2 * k]), None)
                if c is None:
                    raise ImageError("odd scan")
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                own.append(c)
            first, last, both = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            if last > 63:
                raise ImageError("odd scan")
            if len(own) == 1:
                c = own[0]
                units = [[(c, 64 * (y * c.stride + x))] for y in range(c.blocks[1]) for x in range(c.blocks[0])]
            else:
                units = [[(c, 64 * ((my * c.v + y) * c.stride + mx * c.h + x)) for c in own for y in range(c.v) for x in range(c.h)] for my in range(rows) for mx in range(columns)]
            parts = _stretches(data, end)
            each = interval or len(units)
            if len(parts) < -(-len(units) // each):
                raise ImageError("truncated")
            try:
                for k in range(0, len(units), each):
                    scan = _Scan(_Bits(parts[k // each]), tables, first, last, both >> 4, both & 15, frame[2])
                    for c in own:
                        c.before = 0
                    for unit in units[k : k + each]:
                        for c, at in unit:
                            scan.block(c, at)
                    if scan.bits.spent():
                        raise ImageError("truncated")
            except (KeyError, OverflowError) as e:
                raise ImageError("damaged data") from e
            ended = True
    if not frame or not ended:
        raise ImageError("truncated")
    h, w, _ = frame
    planes = []
    for c in components:
        if c.quantiser not in quantisers:
            raise ImageError("no quantiser")
        x = np.frombuffer(c.coefficients, dtype=np.int32).reshape(-1, 64) * quantisers[c.quantiser]
        x = _BASIS.T @ x.reshape(-1, 8, 8) @ _BASIS
        plane = x.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255)[: -(-h * c.v // down), : -(-w * c.h // across)]
        planes.append(_widened(plane, across // c.h, down // c.v)[:h, :w])
    v = np.dstack(planes)
    if v.shape[2] >= 3 and adobe != 0:
        y, cb, cr = v[..., 0], v[..., 1] - 128, v[..., 2] - 128
        if v.shape[2] == 3 or adobe == 2:
            v[..., :3] = np.clip(np.rint(np.dstack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb])), 0, 255)
    if v.shape[2] == 4:  # inks are stored inverted
        v = np.rint(v[..., :3] * v[..., 3:] / 255)
    return v.astype(np.uint8)


def encode_grey(levels: np.ndarray, quantiser: int = 1, orientation: int | None = None) -> bytes:
    """A sequential grey JPEG of byte levels, for fixtures: flat quantiser, codes of 4 bits (DC) and 8 or 9 bits (AC)."""
    levels = np.asarray(levels, dtype=np.float64)
    h, w = levels.shape
    padded = np.pad(levels, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    found = np.rint(_BASIS @ blocks @ _BASIS.T / quantiser).astype(int).reshape(-1, 64)[:, ZIGZAG]
    symbols = [r << 4 | s for s in range(1, 11) for r in range(16)] + [0x00, 0xF0]
    code = {s: (k, 8) if k < 128 else (256 + k - 128, 9) for k, s in enumerate(symbols)}
    out, before = [], 0

    def put(v: int, n: int) -> None:
        if n:
            out.append(format(v, f"0{n}b"))

    def bits_of(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return (v if v >= 0 else v + (1 << n) - 1), n

    for block in found.tolist():
        v, n = bits_of(block[0] - before)
        before = block[0]
        put(n, 4)
        put(v, n)
        skipped = 0
        end = max((k for k in range(1, 64) if block[k]), default=0)
        for k in range(1, end + 1):
            if not block[k]:
                skipped += 1
                continue
            while skipped > 15:
                put(*code[0xF0])
                skipped -= 16
            v, n = bits_of(block[k])
            put(*code[skipped << 4 | n])
            put(v, n)
            skipped = 0
        if end < 63:
            put(*code[0x00])
    text = "".join(out)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\x00") if text else b""
    part = lambda kind, content: struct.pack(">BBH", 0xFF, kind, len(content) + 2) + content
    exif = b"" if orientation is None else part(0xE1, b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0))
    dc, ac = bytes([0, 0, 0, 12] + [0] * 12), bytes([0] * 7 + [128, len(symbols) - 128] + [0] * 7)
    return (
        b"\xff\xd8" + exif + part(0xDB, b"\0" + bytes([quantiser]) * 64) + part(0xC0, struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0))
        + part(0xC4, b"\x00" + dc + bytes(range(12))) + part(0xC4, b"\x10" + ac + bytes(symbols)) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"
    )
