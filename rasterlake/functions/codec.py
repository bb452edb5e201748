"""Deflate tiles: decode a part, restart in the middle, find restart points, undo predictors.

For numpy on the executors; zlib is called through ctypes where Python's module has no way in
(priming with single bits, stopping at block boundaries).
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from dataclasses import dataclass

import numpy as np

from ..model import CorruptObject

WINDOW = 32768
_BLOCK, _OK, _END, _BUF = 5, 0, 1, -5


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong), ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


_found: list = []


def _zlib():
    if not _found:
        lib = ctypes.CDLL(ctypes.util.find_library("z") or "libz.so.1")
        lib.zlibVersion.restype = ctypes.c_char_p
        _found.append(lib)
    return _found[0]


class Inflater:
    """One inflate stream over data in memory; close it."""

    def __init__(self, data: bytes, raw: bool):
        self.lib, self.z = _zlib(), _Stream()
        if self.lib.inflateInit2_(ctypes.byref(self.z), -15 if raw else 15, self.lib.zlibVersion(), ctypes.sizeof(_Stream)) != _OK:
            raise CorruptObject("inflate could not be started")
        self.data = ctypes.create_string_buffer(data, max(1, len(data)))
        self.out = ctypes.create_string_buffer(WINDOW)
        self.z.next_in, self.z.avail_in = ctypes.addressof(self.data), len(data)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.lib.inflateEnd(ctypes.byref(self.z))

    def prime(self, bits: int, value: int) -> None:
        if self.lib.inflatePrime(ctypes.byref(self.z), bits, value) != _OK:
            raise CorruptObject("a restart point's bits were refused")

    def dictionary(self, window: bytes) -> None:
        if self.lib.inflateSetDictionary(ctypes.byref(self.z), window, len(window)) != _OK:
            raise CorruptObject("a restart point's window was refused")

    def step(self, most: int, flush: int = 0) -> tuple[int, bytes]:
        """zlib's answer, and at most `most` bytes."""
        take = min(WINDOW, most)
        self.z.next_out, self.z.avail_out = ctypes.addressof(self.out), take
        rc = self.lib.inflate(ctypes.byref(self.z), flush)
        return rc, self.out.raw[: take - self.z.avail_out]


def is_wrapped(data: bytes) -> bool:
    return len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


def inflate_prefix(data: bytes, need: int) -> bytes:
    """The first `need` bytes of a zlib stream, or as many as `data` gives."""
    try:
        return zlib.decompressobj(15 if is_wrapped(data) else -15).decompress(data, need)
    except zlib.error as e:
        raise CorruptObject(str(e)) from e


def inflate_at(data: bytes, bits: int, window: bytes, need: int) -> bytes:
    """Up to `need` bytes from a restart point on; fewer where the data end or turn bad.

    data begins at the byte that holds the point: the one before in_byte if bits is not 0, of
    which the `bits` high ones are still to be read.
    """
    with Inflater(data[1:] if bits else data, raw=True) as z:
        if bits:
            z.prime(bits, data[0] >> (8 - bits))
        if window:
            z.dictionary(window)
        parts, have = [], 0
        while have < need:
            rc, part = z.step(need - have)
            parts.append(part)
            have += len(part)
            if rc not in (_OK, _BUF) or not part:
                break
        return b"".join(parts)


@dataclass(frozen=True)
class Restart:
    """Where decoding can begin: compressed bytes before it, unused bits of the last, output before it and its end."""

    in_byte: int
    bits: int
    out: int
    window: bytes


def restart_points(data: bytes, span: int) -> tuple[list[Restart], bytes]:
    """Restart points at the first block boundary after every `span` bytes of output, and the output."""
    points: list[Restart] = []
    out = bytearray()
    with Inflater(data, raw=not is_wrapped(data)) as z:
        while True:
            rc, part = z.step(WINDOW, _BLOCK)
            if rc not in (_OK, _END, _BUF):
                raise CorruptObject(f"inflate gave {rc}")
            out += part
            kind = z.z.data_type
            far = len(out) - points[-1].out >= span if points else True
            if kind & 128 and not kind & 64 and len(out) >= WINDOW and far:
                points.append(Restart(int(z.z.total_in), kind & 7, len(out), bytes(out[-WINDOW:])))
            if rc == _END or (not part and not z.z.avail_in):
                return points, bytes(out)


def nearest(points: list[Restart], out: int) -> Restart | None:
    """The last point at or before an output place."""
    return max((p for p in points if p.out <= out), key=lambda p: p.out, default=None)


def read_range(data: bytes, points: list[Restart], a: int, z: int) -> bytes:
    """Output bytes a..z of a whole compressed tile, from the nearest point."""
    p = nearest(points, a)
    if p is None:
        return inflate_prefix(data, z)[a:]
    return inflate_at(data[p.in_byte - (p.bits > 0) :], p.bits, p.window, z - p.out)[a - p.out :]


def consumed_at(data: bytes, places: list[int]) -> list[int]:
    """Compressed bytes used once each of the (rising) output places is reached."""
    done, have, used = [], 0, []
    z = zlib.decompressobj(15 if is_wrapped(data) else -15)
    rest, fed, step = b"", 0, 256
    for place in places:
        while have < place:
            if not rest:
                if fed >= len(data):
                    break
                rest, fed = data[fed : fed + step], fed + step
            part = z.decompress(rest, place - have)
            rest = z.unconsumed_tail
            have += len(part)
            if not part and not rest and fed >= len(data):
                break
        used.append(min(fed, len(data)) - len(rest))
    done.extend(used)
    return done


def range_cost(data: bytes, points: list[Restart], a: int, z: int) -> tuple[int, int]:
    """Compressed bytes fetched and bytes decoded to read output a..z from the nearest point."""
    p = nearest(points, a)
    if p is None:
        return consumed_at(data, [z])[0], z
    first, need = p.in_byte - (p.bits > 0), z - p.out
    lo, hi = 1, len(data) - first
    while lo < hi:  # the least input that gives enough
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(inflate_at(data[first : first + mid], p.bits, p.window, need)) >= need else (mid + 1, hi)
    return lo, need


def undo_predictor(rows: np.ndarray, dtype: str, width: int, predictor: int) -> np.ndarray:
    """Rows of bytes (n x row bytes) as values (n x width)."""
    dt = np.dtype(dtype)
    rows = np.ascontiguousarray(rows)
    if predictor == 3:
        planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(len(rows), dt.itemsize, width)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dt.newbyteorder(">")).reshape(len(rows), width).astype(dt)
    values = rows.view(dt.newbyteorder("<")).reshape(len(rows), width)
    if predictor == 2:
        wide = np.cumsum(values.astype(np.int64) if dt.kind == "i" else values.astype(np.uint64), axis=1)
        return wide.astype(dt)
    return values.astype(dt)


def apply_predictor(values: np.ndarray, predictor: int) -> bytes:
    """The inverse, for writers: values (n x width) to bytes."""
    dt = values.dtype
    if predictor == 2:
        unsigned = values.view(f"u{dt.itemsize}")
        diff = unsigned.copy()
        diff[:, 1:] = unsigned[:, 1:] - unsigned[:, :-1]
        return diff.astype(diff.dtype.newbyteorder("<")).tobytes()
    if predictor == 3:
        planes = values.astype(dt.newbyteorder(">")).view(np.uint8).reshape(len(values), -1, dt.itemsize).transpose(0, 2, 1).reshape(len(values), -1).copy()
        planes[:, 1:] -= planes[:, :-1].copy()
        return planes.tobytes()
    return values.astype(dt.newbyteorder("<")).tobytes()


def layout_fingerprint(offsets, bytecounts) -> str:
    """64-bit FNV-1a over the tile offsets, then their counts, eight bytes each: 16 hex digits."""
    h, mask = 0xCBF29CE484222325, (1 << 64) - 1  # fixed values of FNV-1a
    for b in np.concatenate([np.asarray(offsets, "<i8"), np.asarray(bytecounts, "<i8")]).tobytes():
        h = (h ^ b) * 0x100000001B3 & mask
    return f"{h:016x}"
