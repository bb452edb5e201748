"""Restart points of tiles: built on the executors, kept as a table, exchanged as SBX3 files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import WINDOW, Restart, layout_fingerprint, restart_points
from ..functions.columns import restart_span
from ..model import StaleSidecar, Unsupported
from ..operators.tiles import valid_point
from .transport import as_range, checked

POINTS = "key string, block int, seq int, out long, in_byte long, bits int, window binary, window_crc long, source_size long, layout_hash string, identity string"
# The layout of SBX3 files, little-endian.
_HEAD, _HEAD2, _ENTRY, _POINT = struct.Struct("<4sIIQQH"), struct.Struct("<4sIIQQ"), struct.Struct("<IIQ"), struct.Struct("<QBQI")
MAX_TABLE = 64 << 20


def build(needed: DataFrame, objects: DataFrame, transport, span: int | None = None, share: float = 0.1) -> DataFrame:
    """Restart points (POINTS) of the needed tiles (key, level, block), level 0 only.

    A point at least every `span` output bytes, or as many as take `share` of a tile's compressed
    size; tiles too small for one have none.  An object without identity gives an error row's
    exception: points of an unknown version would never be trusted.
    """
    first = objects.filter("levels is not null").select("key", "size", "identity", F.expr("filter(levels, x -> x.level = 0)[0]").alias("l"))
    if needed.join(first.filter("identity is null"), "key", "left_semi").limit(1).collect():
        raise Unsupported("restart points need an object with an identity")
    jobs = needed.filter("level = 0").select("key", "block").distinct().join(first, "key")
    jobs = jobs.select("key", "block", "size", "identity", F.expr("l.offsets[block]").alias("offset"), F.expr("l.bytecounts[block]").alias("bytecount"), (F.col("l.blockw").cast("long") * F.col("l.blockh") * F.col("l.itemsize")).alias("total"), F.col("l.offsets").alias("offsets"), F.col("l.bytecounts").alias("bytecounts"))
    jobs = jobs.filter("bytecount > 0").withColumn("span", F.lit(span).cast("long") if span else restart_span(F.col("bytecount"), F.col("total"), share)).filter("span is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for job in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                data = checked(as_range(transport.get_range(job["key"], job["offset"], job["bytecount"])), job["size"], job["identity"], job["key"]).data
                found = restart_points(data, job["span"])[0]
                name = layout_fingerprint(job["offsets"], job["bytecounts"])
                rows = [(job["key"], job["block"], k, p.out, p.in_byte, p.bits, p.window, zlib.crc32(p.window), job["size"], name, job["identity"]) for k, p in enumerate(found)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=[x.split()[0] for x in POINTS.split(", ")])

    return jobs.mapInArrow(run, POINTS)


def status(points: DataFrame, objects: DataFrame) -> DataFrame:
    """Of each object with points (key, status): loaded if all fit the object as it is now; stale if they were made for another
    size, layout or identity, or for one unknown; invalid if a window or place is unsound.

    An object with one bad point loses all: its points came from one build.
    """
    now = objects.select(F.col("key"), F.col("size").alias("now_size"), F.col("identity").alias("now_identity"), F.expr("filter(levels, x -> x.level = 0)[0]").alias("l"))
    p = points.join(now, "key")
    total = F.col("l.blockw").cast("long") * F.col("l.blockh") * F.col("l.itemsize")
    layout = layout_of(objects).select("key", F.col("layout_hash").alias("now_layout"))
    p = p.join(layout, "key", "left")
    same = (F.col("source_size") == F.col("now_size")) & (F.col("layout_hash") == F.col("now_layout")) & (F.col("identity") == F.col("now_identity")) & (F.col("identity") != "")
    sound = valid_point(F.expr("get(l.bytecounts, block)"), total, F.col("in_byte"), F.col("bits"), F.col("out"), F.octet_length("window")) & (F.crc32("window") == F.col("window_crc"))
    no = F.lit(False)
    g = p.groupBy("key").agg(F.bool_and(F.coalesce(same, no)).alias("same"), F.bool_and(F.coalesce(sound, no)).alias("sound"))
    return g.select("key", F.when(~F.col("same"), "stale").when(~F.col("sound"), "invalid").otherwise("loaded").alias("status"))


def layout_of(objects: DataFrame) -> DataFrame:
    """key, layout_hash of level 0 of objects."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            names = [None if o is None else layout_fingerprint(o, n) for o, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=["key", "layout_hash"])

    first = objects.filter("levels is not null").select("key", F.expr("filter(levels, x -> x.level = 0)[0]").alias("l"))
    return first.select("key", F.col("l.offsets").alias("o"), F.col("l.bytecounts").alias("n")).mapInArrow(run, "key string, layout_hash string")


def usable(points: DataFrame, objects: DataFrame) -> DataFrame:
    """The points of the objects whose status is loaded."""
    return points.join(status(points, objects).filter("status = 'loaded'"), "key", "left_semi")


def missing(needed: DataFrame, points: DataFrame) -> DataFrame:
    """The needed tiles that have no points yet: build() on them adds to what is there."""
    return needed.join(points.select("key", "block").distinct(), ["key", "block"], "left_anti")


def index_bytes(points: DataFrame) -> DataFrame:
    """Size of each object's points: key, bytes."""
    return points.groupBy("key").agg(F.sum(F.octet_length("window") + 16).alias("bytes"))


def to_sbx(points: dict[int, list[Restart]], source_size: int, layout_hash: str, identity: str, span: int = 0) -> bytes:
    """An SBX3 file's bytes, blocks in order."""
    name = identity.encode()
    if not 1 <= len(name) <= 4096:
        raise ValueError("an identity has 1 to 4096 bytes")
    if any(not 0 <= p.bits <= 7 or len(p.window) > WINDOW for ps in points.values() for p in ps):
        raise ValueError("a restart point is out of range")
    head = _HEAD.pack(b"SBX3", span, len(points), source_size, int(layout_hash, 16), len(name)) + name
    table, body, at = b"", b"", len(head) + _ENTRY.size * len(points)
    for block in sorted(points):
        table += _ENTRY.pack(block, len(points[block]), at + len(body))
        body += b"".join(_POINT.pack(p.in_byte, p.bits, p.out, len(p.window)) + p.window for p in points[block])
    return head + table + body


class Sidecar:
    """An SBX3 or SBX2 file; points of a block are parsed when they are asked for.

    SBX2 files name no source identity: they are of an unknown version, so check() refuses them.
    Raises ValueError if the head or the table of blocks is broken.
    """

    def __init__(self, data: bytes):
        self.data = data
        try:
            if data[:4] == b"SBX3":
                _, self.span, n, self.source_size, layout, length = _HEAD.unpack_from(data)
                self.identity = data[_HEAD.size : _HEAD.size + length].decode()
                at = _HEAD.size + length
                if not self.identity or length > 4096 or len(data) < at:
                    raise ValueError("a broken identity")
            elif data[:4] == b"SBX2":
                _, self.span, n, self.source_size, layout = _HEAD2.unpack_from(data)
                self.identity, at = "", _HEAD2.size
            else:
                raise ValueError("not a sidecar file")
            self.layout_hash = f"{layout:016x}"
            if n * _ENTRY.size > min(MAX_TABLE, len(data) - at):
                raise ValueError("a broken table")
            table = [_ENTRY.unpack_from(data, at + k * _ENTRY.size) for k in range(n)]
        except (struct.error, UnicodeDecodeError) as e:
            raise ValueError(f"a broken file: {e}") from e
        self.table = {block: (count, place) for block, count, place in table}
        if len(self.table) != n or any(place < at + n * _ENTRY.size or place > len(data) for _, place in self.table.values()):
            raise ValueError("a block comes twice or lies outside")

    def check(self, source_size: int | None = None, layout_hash: str | None = None, identity: str | None = None) -> Sidecar:
        """Itself, if it is of this object: StaleSidecar if not, or if either side's identity is unknown."""
        for name, want in (("source_size", source_size), ("layout_hash", layout_hash), ("identity", identity)):
            if want is not None and (getattr(self, name) != want or not want):
                raise StaleSidecar(f"{name} is {getattr(self, name)!r}, not {want!r}")
        return self

    def points(self, block: int) -> list[Restart]:
        """Points of a block in order; none for a block that isn't there.  ValueError if they are broken."""
        count, at = self.table.get(block, (0, 0))
        found: list[Restart] = []
        try:
            for _ in range(count):
                in_byte, bits, place, size_of = _POINT.unpack_from(self.data, at)
                window = self.data[at + _POINT.size : at + _POINT.size + size_of]
                if bits > 7 or size_of > WINDOW or len(window) != size_of or (found and (place <= found[-1].out or in_byte < found[-1].in_byte)):
                    raise ValueError("a broken point")
                found.append(Restart(in_byte, bits, place, window))
                at += _POINT.size + size_of
        except struct.error as e:
            raise ValueError(f"a broken file: {e}") from e
        return found

    def best(self, block: int, out: int) -> Restart | None:
        """The last point of a block at or before a place in its bytes."""
        return max((p for p in self.points(block) if p.out <= out), key=lambda p: p.out, default=None)


def from_sbx(data: bytes, source_size: int | None = None, layout_hash: str | None = None, identity: str | None = None) -> dict[int, list[Restart]]:
    """Points by block; StaleSidecar if they are of another object, ValueError if the file is broken."""
    side = Sidecar(data).check(source_size, layout_hash, identity)
    return {block: side.points(block) for block in side.table}


def read_sbx(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Points (POINTS, and error) of all SBX files under a path; an object's key is the file's path after `root`, without .sbx.

    A file that is broken gives one row with its key and error.
    """
    names = [x.split()[0] for x in POINTS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    s = Sidecar(data)
                    rows = [(key, block, k, p.out, p.in_byte, p.bits, p.window, zlib.crc32(p.window), s.source_size, s.layout_hash, s.identity, None) for block in s.table for k, p in enumerate(s.points(block))]
                except ValueError as e:
                    rows = [(key, *[None] * 10, str(e))]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=[*names, "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sbx").option("recursiveFileLookup", True).load(path)
    key = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), r"\.sbx$", "")
    return files.select(F.regexp_replace(key, "^" + (root.rstrip("/") + "/" if root else "/"), "").alias("key"), "content").mapInArrow(run, f"{POINTS}, error string")


def write_sbx(points: DataFrame, folder: str) -> DataFrame:
    """Points as one SBX3 file for each object, in a folder that all executors reach: key, path, bytes.

    An object's points meet in one task; a file is moved into place once it is whole.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        blocks: dict[int, list[Restart]] = {}
        first = None
        for r in table.sort_by([("block", "ascending"), ("out", "ascending")]).to_pylist():
            first = first or r
            blocks.setdefault(r["block"], []).append(Restart(r["in_byte"], r["bits"], r["out"], r["window"]))
        data = to_sbx(blocks, first["source_size"], first["layout_hash"], first["identity"])
        name = f"{root}/{first['key']}.sbx"
        store.create_dir(name.rpartition("/")[0], recursive=True)
        new = f"{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            f.write(data)
        store.move(new, name)
        return pa.table({"key": [first["key"]], "path": [name], "bytes": pa.array([len(data)], pa.int64())})

    return points.groupBy("key").applyInArrow(run, "key string, path string, bytes long")
