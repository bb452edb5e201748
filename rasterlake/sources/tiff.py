"""Tiled TIFF and BigTIFF headers, and a small writer for test files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from ..functions.codec import apply_predictor
from ..model import CorruptObject

# Bytes of each field type, and struct's letter for it.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "uint", 2: "int", 3: "float"}


class Header:
    """Reads `read(start, length)` in blocks and keeps them."""

    def __init__(self, read: Callable[[int, int], bytes], block: int = 32768):
        self.read, self.block, self.kept = read, block, {}

    def __call__(self, start: int, length: int) -> bytes:
        out = b""
        for k in range(start // self.block, (start + max(1, length) - 1) // self.block + 1):
            if k not in self.kept:
                self.kept[k] = self.read(k * self.block, self.block)
            out += self.kept[k]
        at = start % self.block
        if len(out) < at + length:
            raise CorruptObject("the header ends early")
        return out[at : at + length]


def describe(read: Callable[[int, int], bytes], size: int, max_tags: int = 4096) -> dict:
    """The object record of a file: its levels with tile offsets and byte counts.

    Raises CorruptObject for what isn't a tiled TIFF whose tables match its grid.
    """
    get = Header(read)
    try:
        return _describe(get, size, max_tags)
    except (struct.error, OverflowError, MemoryError, KeyError, ZeroDivisionError, UnicodeDecodeError, ValueError, IndexError) as e:
        raise CorruptObject(f"bad header: {e}") from e


def _describe(get: Header, size: int, max_tags: int) -> dict:
    magic = get(0, 4)
    order = {b"II": "<", b"MM": ">"}[magic[:2]]
    version = struct.unpack(order + "H", magic[2:])[0]
    if version not in (42, 43):
        raise CorruptObject("not a TIFF")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), get(8 if big else 4, 8 if big else 4))[0]
    count, entry, offset = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    levels, nodata, transform, epsg, seen = [], None, None, None, set()
    while at:
        if at in seen or len(seen) > 64:
            raise CorruptObject("the directories form a loop")
        seen.add(at)
        n = struct.unpack(order + count, get(at, struct.calcsize(order + count)))[0]
        if n > max_tags:
            raise CorruptObject("too many tags")
        width = struct.calcsize(order + entry) + (8 if big else 4)
        body = get(at + struct.calcsize(order + count), n * width + struct.calcsize(order + offset))
        tags = {}
        for i in range(n):
            tag, kind, number = struct.unpack_from(order + entry, body, i * width)
            if kind not in _TYPES:
                continue
            letter = _TYPES[kind]
            each = struct.calcsize(order + letter)
            if number * each > size:
                raise CorruptObject("a tag is larger than the file")
            value = i * width + struct.calcsize(order + entry)
            raw = body[value : value + number * each] if number * each <= (8 if big else 4) else get(struct.unpack_from(order + offset, body, value)[0], number * each)
            tags[tag] = raw if kind == 2 else struct.unpack(order + letter * number, raw)
        at = struct.unpack_from(order + offset, body, n * width)[0]
        one = lambda tag, other=None: tags[tag][0] if tag in tags else other
        if 322 not in tags or 324 not in tags:
            raise CorruptObject("an image is not tiled")
        w, h, bw, bh, samples, planar = tags[256][0], tags[257][0], tags[322][0], tags[323][0], one(277, 1), one(284, 1)
        nbx, nby, planes = -(-w // bw), -(-h // bh), samples if planar == 2 else 1
        offsets, counts = tags[324], tags[325]
        if len(offsets) != nbx * nby * planes or len(counts) != len(offsets):
            raise CorruptObject("the tile tables do not match the grid")
        bits = one(258, 1)
        kind = _KINDS.get(one(339, 1), "other")
        levels.append({
            "level": len(levels), "is_mask": one(262) == 4 or bool(one(254, 0) & 4), "width": w, "height": h, "blockw": bw, "blockh": bh, "nbx": nbx, "nby": nby, "nplanes": planes, "dtype": f"{kind}{bits}", "itemsize": bits // 8,
            "samples": samples, "planar": planar, "compression": one(259, 1), "predictor": one(317, 1), "byteorder": order, "offsets": list(offsets), "bytecounts": list(counts),
        })
        if len(levels) == 1:
            text = tags.get(42113, b"").decode("ascii", "replace").strip("\0 ")
            try:
                nodata = float(text)
            except ValueError:
                nodata = None
            if 33550 in tags and 33922 in tags:
                (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
                transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
            keys = tags.get(34735, ())
            found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
            epsg = found.get(3072) or found.get(2048)
    starts = [o for lv in levels for o in lv["offsets"] if o]
    return {"size": size, "bigtiff": big, "nodata": nodata, "header_bytes": min(starts, default=size), "transform": transform, "epsg": epsg, "levels": levels}


def write(images: list[np.ndarray], tile: int, predictor: int = 1, compression: int = 8, big: bool = False, nodata: float | None = None, order: str = "<", level: int = 6, empty: set[int] = frozenset(), transform: tuple[float, float, float, float] | None = None) -> bytes:
    """A tiled file of full-size and smaller images, for tests; `empty`: blocks of the first that are not stored."""
    fields = []
    kinds = {"u": 1, "i": 2, "f": 3}
    for k, image in enumerate(images):
        h, w = image.shape
        nbx, nby = -(-w // tile), -(-h // tile)
        padded = np.zeros((nby * tile, nbx * tile), image.dtype)
        padded[:h, :w] = image
        datas = []
        for b in range(nbx * nby):
            y, x = b // nbx * tile, b % nbx * tile
            raw = apply_predictor(np.ascontiguousarray(padded[y : y + tile, x : x + tile]), predictor)
            datas.append(b"" if k == 0 and b in empty else zlib.compress(raw, level) if compression in (8, 32946) else raw)
        fields.append((image, nbx * nby, datas))
    width = 8 if big else 4
    first = 16 if big else 8
    sizes = []
    for image, n, _ in fields:
        tags = 13 + (2 if transform else 0) + (nodata is not None)
        sizes.append((8 if big else 2) + tags * (20 if big else 12) + width + 2 * n * width + 64 + 72)
    starts = [first + sum(sizes[:k]) for k in range(len(fields))]
    at = first + sum(sizes)
    out = bytearray(at)
    magic = b"II" if order == "<" else b"MM"
    out[:first] = struct.pack(order + "2sHHHQ", magic, 43, 8, 0, first) if big else struct.pack(order + "2sHI", magic, 42, first)
    for k, (image, n, datas) in enumerate(fields):
        offsets, counts = [], []
        for d in datas:
            offsets.append(len(out) if d else 0)
            counts.append(len(d))
            out += d
        spare = starts[k] + sizes[k] - (2 * n * width + 64 + 72)

        def place(raw: bytes) -> int:
            nonlocal spare
            out[spare : spare + len(raw)] = raw
            spare += len(raw)
            return spare - len(raw)

        letter = "Q" if big else "I"
        long = 16 if big else 4
        rows = [(254, 4, 1, [int(k > 0)]), (256, 4, 1, [image.shape[1]]), (257, 4, 1, [image.shape[0]]), (258, 3, 1, [image.dtype.itemsize * 8]), (259, 3, 1, [compression]), (262, 3, 1, [1]), (277, 3, 1, [1]), (317, 3, 1, [predictor]), (322, 4, 1, [tile]), (323, 4, 1, [tile]), (324, long, n, offsets), (325, long, n, counts), (339, 3, 1, [kinds[image.dtype.kind]])]
        if transform:
            x, y, sx, sy = transform
            rows += [(33550, 12, 3, [sx, sy, 0.0]), (33922, 12, 6, [0.0, 0.0, 0.0, x, y, 0.0])]
        if nodata is not None:
            text = f"{nodata:g}".encode() + b"\0"
            rows.append((42113, 2, len(text), text))
        rows = [r for r in rows if r[0] != 284]
        body = struct.pack(order + ("Q" if big else "H"), len(rows))
        for tag, kind, number, values in rows:
            raw = values if kind == 2 else struct.pack(order + _TYPES[kind] * number, *values)
            value = raw.ljust(width, b"\0") if len(raw) <= width else struct.pack(order + letter, place(raw))
            body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, number) + value
        body += struct.pack(order + letter, starts[k + 1] if k + 1 < len(starts) else 0)
        out[starts[k] : starts[k] + len(body)] = body
    return bytes(out)
