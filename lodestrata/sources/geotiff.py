"""GeoTIFF files without compression or deflated, in strips or tiles: to numpy arrays and back."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# fixed values of the format: sizes of field types, and dtypes by (sample format, bits)
_SIZE = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_DTYPE = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Raster:
    """data[band, row, column]; x0, y0 is the upper left corner, dx and dy the size of a pixel (both positive, north up)."""

    data: np.ndarray
    x0: float
    y0: float
    dx: float
    dy: float
    srid: int = 4326
    nodata: float | None = None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        _, h, w = self.data.shape
        return self.x0, self.y0 - h * self.dy, self.x0 + w * self.dx, self.y0

    def valid(self, band: int = 0) -> np.ndarray:
        a = self.data[band].astype(float)
        ok = ~np.isnan(a)
        return ok if self.nodata is None else ok & (a != self.nodata)


def read(raw: bytes) -> Raster:
    e = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if e is None or struct.unpack_from(e + "H", raw, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack_from(e + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(e + "H", raw, at)[0]):
        tag, kind, n, _ = struct.unpack_from(e + "HHII", raw, at + 2 + 12 * i)
        fmt = _SIZE.get(kind)
        if fmt is None:
            continue
        size = struct.calcsize(e + fmt) * n
        pos = at + 10 + 12 * i if size <= 4 else struct.unpack_from(e + "I", raw, at + 10 + 12 * i)[0]
        tags[tag] = raw[pos : pos + n] if kind == 2 else struct.unpack_from(e + fmt * n, raw, pos)
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    dtype = np.dtype(_DTYPE[tags.get(339, (1,))[0], tags.get(258, (8,))[0]]).newbyteorder(e)
    packing = tags.get(259, (1,))[0]
    if packing not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packing} is not supported")
    planar = tags.get(284, (1,))[0] == 2
    tiled = 322 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, tags.get(278, (h,))[0])
    starts, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((bands, h, w), dtype.newbyteorder("="))
    per = 1 if planar else bands
    for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        block = raw[s : s + n]
        block = zlib.decompress(block) if packing != 1 else block
        b, k = divmod(k, across * down) if planar else (0, k)
        r, c = divmod(k, across)
        rows = bh if tiled else min(bh, h - r * bh)
        a = np.frombuffer(block, dtype, rows * bw * per).reshape(rows, bw, per)
        if tags.get(317, (1,))[0] == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        hh, ww = min(rows, h - r * bh), min(bw, w - c * bw)
        for p in range(per):
            out[b + p, r * bh : r * bh + hh, c * bw : c * bw + ww] = a[:hh, :ww, p]
    dx, dy = tags.get(33550, (1.0, 1.0, 0.0))[:2]
    tie = tags.get(33922, (0, 0, 0, 0.0, float(h), 0))
    keys = tags.get(34735, ())
    srid = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), 4326)
    none = tags.get(42113)
    return Raster(out, tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy, srid, float(none.split(b"\0")[0]) if none else None)


def write(r: Raster) -> bytes:
    bands, h, w = r.data.shape
    d = np.ascontiguousarray(r.data.transpose(1, 2, 0)).astype(r.data.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[d.dtype.kind]
    body = d.tobytes()
    geographic = r.srid in (4326, 4258)
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, r.srid)
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (d.dtype.itemsize * 8,) * bands), (259, 3, (1,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (bands,)), (278, 4, (h,)), (279, 4, (len(body),)), (284, 3, (1,)), (339, 3, (kind,) * bands), (33550, 12, (r.dx, r.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, r.x0, r.y0, 0.0)), (34735, 3, keys)]
    if r.nodata is not None:
        fields.append((42113, 2, repr(r.nodata).encode() + b"\0"))
    at = 8 + len(body) + len(body) % 2
    tail, entries, free = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, t, v in fields:
        raw = v if t == 2 else struct.pack("<" + _SIZE[t] * len(v), *v)
        if len(raw) <= 4:
            slot = raw.ljust(4, b"\0")
        else:
            slot = struct.pack("<I", free + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, t, len(v)) + slot
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + tail
