"""Reading pixels: one plan for a whole batch, then one Arrow stage that fetches and decodes.

Rows are checked first and refused as a batch; tiles are planned once each, their ranges joined,
and the ranges dealt over tasks.  A task fetches a range, decodes each tile's rows once, and
gives every request its part; parts are put together by request.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codec import inflate_at, inflate_prefix, is_wrapped, undo_predictor
from .model import CorruptObject, ObjectChanged, Options, TransportError, Unsupported, requests
from .operators import checks, tiles
from .sources import catalog, restart
from .sources.transport import as_range, checked

PARTS = "req_id long, dy0 int, dx0 int, h int, w int, dtype string, data binary, value double, requests long, bytes long, retries long, blocks long, groups long, undershoots long, restarted long, window_bytes long, whole_bytes long, extra_bytes long, error string"
_COUNTED = ("requests", "bytes", "retries", "blocks", "groups", "undershoots", "restarted", "window_bytes", "whole_bytes", "extra_bytes")
SLICE = 4096  # requests that a task holds as rows at once
ITEMS = 65536  # requests of a tile that one task takes; a tile with more is decoded by several
_log = logging.getLogger(__name__)


@dataclass
class Stats:
    """What a lake has fetched so far, summed over its reads."""

    requests: int = 0
    bytes: int = 0
    retries: int = 0
    blocks: int = 0
    groups: int = 0
    undershoots: int = 0
    restarted: int = 0
    window_bytes: int = 0
    whole_bytes: int = 0
    extra_bytes: int = 0
    sidecars_loaded: int = 0
    sidecars_missing: int = 0
    stale_sidecars: int = 0
    invalid_sidecars: int = 0
    delegated: int = 0

    def add(self, counts: dict[str, int]) -> None:
        for k, v in counts.items():
            setattr(self, k, getattr(self, k) + int(v or 0))

    def as_dict(self) -> dict:
        """All counters, and bytes of whole tiles over those fetched and tiles a request (null without any)."""
        return asdict(self) | {"gain_over_whole_blocks": round(self.whole_bytes / self.bytes, 3) if self.bytes else None, "blocks_per_request": round(self.blocks / self.requests, 2) if self.requests else None}


class Lake:
    """Reads from the objects of a catalog (see sources.catalog) through a transport.

    points: restart points (see sources.restart), used for level 0.  They are checked against the
    objects first; an object with a point that does not fit reads without any.  identities: table
    (key, identity) of the caller's own names for contents, which replace the objects' where
    points are checked.  A lake is a plan maker: it holds no connection, and using it from several
    threads is as safe as the session is.  `stats` adds up over reads.
    """

    def __init__(self, spark: SparkSession, objects: DataFrame, transport, options: Options = Options(), points: DataFrame | None = None, identities: DataFrame | None = None):
        self.spark, self.objects, self.transport, self.options = spark, objects, transport, options
        self.levels, self.tiles = tiles.levels_of(objects.filter("levels is not null")), tiles.tiles_of(objects.filter("levels is not null"))
        self.stats = Stats()
        self._closed, self._warned, self._kept = False, False, []
        self.points = None
        if points is not None:
            named = objects
            if identities is not None:
                own = identities.select("key", F.col("identity").alias("_own"))
                named = objects.join(own, "key", "left").withColumn("identity", F.coalesce("_own", "identity")).drop("_own")
            self.status = restart.status(points, named)
            self.points = points.join(self.status.filter("status = 'loaded'"), "key", "left_semi")

    def __enter__(self) -> Lake:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._closed = True
        for table in self._kept:
            table.unpersist()
        self._kept = []

    def _frame(self, rows) -> DataFrame:
        if self._closed:
            raise RuntimeError("this lake is closed")
        return rows if isinstance(rows, DataFrame) else requests(self.spark, rows)

    def why_unsupported(self, key: str, level: int = 0) -> str | None:
        return checks.reasons(self.objects, self._frame([(key, level, 0, 0, 1, 1)]), self.options).first().reason

    def supports(self, key: str, level: int = 0) -> bool:
        return self.why_unsupported(key, level) is None

    def split(self, rows) -> tuple[DataFrame, DataFrame]:
        return checks.split(self.objects, self._frame(rows), self.options)

    def retry(self) -> Lake:
        """A lake in which objects that could not be described have been tried again."""
        return Lake(self.spark, catalog.retry(self.objects, self.transport), self.transport, self.options, self.points)

    def plan(self, rows) -> DataFrame:
        """Jobs: one for each touched tile, with the bytes to fetch."""
        found = tiles.items(self._frame(rows), self.levels)
        return tiles.fetch_plan(tiles.jobs(found, self.tiles), self.levels, self.options, self.points)

    def coalesce(self, planned: DataFrame) -> DataFrame:
        return tiles.coalesce(planned, self.options)

    def refuse(self, rows: DataFrame, allow_partial: bool = False) -> None:
        """Unsupported, with the first three reasons, if anything in the batch can't be read."""
        bad = [(r.key, r.level, r.reason) for r in checks.reasons(self.objects, rows, self.options).filter("reason is not null").orderBy("key", "level").limit(3).collect()]
        bad = bad or [(r.req_id, r.why) for r in checks.out_of_bounds(rows, self.levels, allow_partial).orderBy("req_id").limit(3).collect()]
        if bad:
            raise Unsupported("; ".join(" ".join(map(str, b)) for b in bad))
        if checks.output_bytes(rows, self.levels).first().bytes > self.options.max_output_bytes:
            raise Unsupported("the windows are larger than max_output_bytes")

    def read_frame(self, rows, allow_partial: bool = False) -> DataFrame:
        """Parts of the windows, a row for each request and tile (PARTS), in the object's own type.

        Where a range failed there is a row with `error` for each request that it was for.
        """
        rows = self._frame(rows)
        self.refuse(rows, allow_partial)
        found = tiles.items(rows, self.levels)
        planned = tiles.fetch_plan(tiles.jobs(found, self.tiles), self.levels, self.options, self.points).persist()
        self._kept.append(planned)
        large = tiles.too_large(planned, self.options).select("key", "block").limit(3).collect()
        if large:
            raise Unsupported(f"a tile needs more than max_fetch_bytes: {large}")
        groups = self.coalesce(planned).select("key", "level", "group_id", F.col("start").alias("g_start"), F.col("length").alias("g_length"), "extra_bytes", F.explode("blocks").alias("block"))
        geometry = self.levels.select("key", "level", "dtype", "predictor", "object_size", F.coalesce("nodata", F.lit(0.0)).alias("fill"))
        identity = self.objects.select("key", "identity")
        # a tile that very many ask for is dealt to several tasks, each with its own fetch
        n_parts = F.greatest(F.lit(1), F.ceil(F.col("n_items") / ITEMS)).cast("int")
        of_tile = found.join(planned.select(*tiles.TILE, n_parts.alias("n_parts"), "n_items"), tiles.TILE)
        # lists stay short: those of one tile and part meet again in the task that reads it
        n_slices = F.ceil(F.least(F.col("n_items"), F.lit(ITEMS)) / SLICE)
        of_tile = of_tile.withColumn("part", F.pmod(F.xxhash64("req_id"), "n_parts").cast("int")).withColumn("slice", F.pmod(F.xxhash64(F.lit(1), "req_id"), n_slices)).groupBy(*tiles.TILE, "part", "slice").agg(F.collect_list(F.struct("req_id", "ly0", "ly1", "lx0", "lx1", "dy0", "dx0")).alias("items"))
        jobs = planned.join(geometry, ["key", "level"]).join(identity, "key").join(groups, ["key", "level", "block"], "left").join(of_tile, tiles.TILE)
        jobs = jobs.withColumn("_out", F.col("point.out"))
        if self.points is not None:
            # windows are fetched for the points that are used only
            windows = self.points.select("key", F.lit(0).alias("level"), "block", F.col("out").alias("_out"), F.col("window").alias("p_window"))
            jobs = jobs.join(windows, ["key", "level", "block", "_out"], "left")
        else:
            jobs = jobs.withColumn("p_window", F.lit(None).cast("binary"))
        cols = [F.col(f"point.{c}").alias(f"p_{c}") for c in ("in_byte", "bits", "out")]
        # tiles that aren't stored need no range, and are no group
        flat = jobs.select("key", "level", F.coalesce("group_id", -1 - F.col("block")).alias("group_id"), "part", "block", "g_start", "g_length", "extra_bytes", "offset", "bytecount", "start", "prefix", "shallow", "deep", "blockw", "blockh", "itemsize", "dtype", "predictor", "object_size", "identity", "fill", *cols, "p_window", "items")
        n = max(self.options.workers, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = flat.repartition(n, "key", "level", "group_id", "part").sortWithinPartitions("key", "level", "group_id", "part", "start", "block")
        transport = self.transport

        def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            group: list[dict] = []
            name = lambda job: (job["key"], job["level"], job["group_id"], job["part"])
            for b in it:
                jobs, items = b.drop_columns(["items"]), b.column("items")
                for at in range(b.num_rows):
                    # items stay columns: as dicts those of a range would take some hundred bytes each
                    job = jobs.slice(at, 1).to_pylist()[0] | {"items": [items.slice(at, 1).flatten()]}
                    if group and name(job) != name(group[0]):
                        yield from _run(transport, group)
                        group = []
                    if group and job["block"] == group[-1]["block"]:
                        group[-1]["items"] += job["items"]
                    else:
                        group.append(job)
            if group:
                yield from _run(transport, group)

        return dealt.mapInArrow(run, PARTS)

    def read(self, rows, allow_partial: bool = False) -> list[np.ndarray]:
        """Windows in the order of the requests, in the objects' own types; outside the image 0."""
        frame = self._frame(rows)
        kinds = self.levels.select("key", "level", "dtype")
        wanted = frame.join(kinds, ["key", "level"], "left").orderBy("req_id").select("req_id", "w", "h", "dtype").collect()
        out = {r.req_id: np.zeros((max(0, r.h), max(0, r.w)), r.dtype or "f8") for r in wanted}
        counts = dict.fromkeys(_COUNTED, 0)
        errors = []
        for p in self.read_frame(frame, allow_partial).toLocalIterator():
            for k in _COUNTED:
                counts[k] += p[k] or 0
            if p.error:
                errors.append(p.error)
            elif p.h:
                out[p.req_id][p.dy0 : p.dy0 + p.h, p.dx0 : p.dx0 + p.w] = np.frombuffer(p.data, p.dtype).reshape(p.h, p.w)
        self.stats.add(counts)
        if errors:
            kind, _, text = errors[0].partition(": ")
            raise {"ObjectChanged": ObjectChanged, "CorruptObject": CorruptObject, "Unsupported": Unsupported}.get(kind, TransportError)(text)
        if self.points is not None:
            self._count_sidecars(frame, counts)
        return [out[r.req_id] for r in wanted]

    def _count_sidecars(self, frame: DataFrame, counts: dict) -> None:
        n = {r.status: r["count"] for r in frame.select("key").distinct().join(self.status, "key", "left").select(F.coalesce("status", F.lit("missing")).alias("status")).groupBy("status").count().collect()}
        self.stats.add({"sidecars_loaded": n.get("loaded", 0), "sidecars_missing": n.get("missing", 0), "stale_sidecars": n.get("stale", 0), "invalid_sidecars": n.get("invalid", 0)})
        if counts["blocks"] and not counts["restarted"] and not self._warned:
            self._warned = True
            why = f"{n['loaded']} objects have some, but none before the rows read" if n.get("loaded") else f"{n.get('stale', 0)} are stale and {n.get('invalid', 0)} invalid" if n.get("stale") or n.get("invalid") else "no object read has any"
            _log.warning("no restart point was used: %s", why)

    def sample(self, points) -> np.ndarray:
        """Values of (key, x, y) points at level 0."""
        return np.array([w[0, 0] for w in self.read(points)])

    def sample_frame(self, rows) -> DataFrame:
        """req_id, value, error: as sample, for requests of any number; a request whose range failed has its error and no value."""
        return self.read_frame(rows).select("req_id", "value", "error")

    def read_any_frame(self, rows, fallback, allow_partial: bool = False) -> DataFrame:
        """As read_frame, and where nothing can be read here, what fallback(key, level, x, y, w, h) gives, called on the executors.

        fallback returns an array of h x w values.
        """
        frame = self._frame(rows)
        if frame.filter("w <= 0 or h <= 0").limit(1).collect():
            raise Unsupported("the size must be positive")
        if checks.output_bytes(frame).first().bytes > self.options.max_output_bytes:
            raise Unsupported("the windows are larger than max_output_bytes")
        fast, slow = self.split(frame)
        n = max(self.options.workers, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in it:
                for r in b.to_pylist():
                    try:
                        a = np.asarray(fallback(r["key"], r["level"], r["x"], r["y"], r["w"], r["h"]))
                        part = {"dy0": 0, "dx0": 0, "h": a.shape[0], "w": a.shape[1], "dtype": str(a.dtype), "data": a.tobytes(), "value": float(a.flat[0]) if a.size else None}
                    except Exception as e:  # kept as data, as ranges that fail are
                        part = {"error": f"TransportError: {type(e).__name__}: {e}"}
                    yield _batch([{"req_id": r["req_id"]} | part])

        own = slow.select("req_id", "key", "level", "x", "y", "w", "h").repartition(n, "req_id").mapInArrow(run, PARTS)
        return self.read_frame(fast, allow_partial).unionByName(own)

    def read_any(self, rows, fallback, allow_partial: bool = False) -> list[np.ndarray]:
        """As read; what can't be read here goes to fallback (see read_any_frame)."""
        frame = self._frame(rows)
        wanted = frame.select("req_id", "w", "h").orderBy("req_id").collect()
        parts: dict[int, list] = {r.req_id: [] for r in wanted}
        counts = dict.fromkeys(_COUNTED, 0)
        for p in self.read_any_frame(frame, fallback, allow_partial).toLocalIterator():
            for k in _COUNTED:
                counts[k] += p[k] or 0
            if p.error:
                kind, _, text = p.error.partition(": ")
                raise {"ObjectChanged": ObjectChanged, "CorruptObject": CorruptObject, "Unsupported": Unsupported}.get(kind, TransportError)(text)
            if p.req_id is not None:
                parts[p.req_id].append(p)
        self.stats.add(counts)
        self.stats.add({"delegated": self.split(frame)[1].count()})
        out = []
        for r in wanted:
            own = np.zeros((r.h, r.w), parts[r.req_id][0].dtype if parts[r.req_id] else "f8")
            for p in parts[r.req_id]:
                own[p.dy0 : p.dy0 + p.h, p.dx0 : p.dx0 + p.w] = np.frombuffer(p.data, p.dtype).reshape(p.h, p.w)
            out.append(own)
        return out


_SCHEMA = pa.schema([(a, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[b]) for a, b in (x.split() for x in PARTS.split(", "))])


def _batch(parts: list[dict]) -> pa.RecordBatch:
    blank = dict.fromkeys(_SCHEMA.names) | dict.fromkeys(_COUNTED, 0)
    return pa.RecordBatch.from_pylist([blank | p for p in parts], schema=_SCHEMA)


class _Parts:
    """Parts of requests, as columns but for the last few and the first, which carries the counts in the end."""

    def __init__(self):
        self.first: list[dict] = []
        self.rows: list[dict] = []
        self.batches: list[pa.RecordBatch] = []

    def append(self, part: dict) -> None:
        if not self.first:
            self.first.append(part)
            return
        self.rows.append(part)
        if len(self.rows) == SLICE:
            self.batches.append(_batch(self.rows))
            self.rows = []

    def all(self, counts: dict) -> Iterator[pa.RecordBatch]:
        yield _batch([p | counts for p in self.first])
        yield from self.batches
        if self.rows:
            yield _batch(self.rows)


def _items(job: dict) -> Iterator[dict]:
    for some in job["items"]:
        for at in range(0, len(some), SLICE):
            yield from some.slice(at, SLICE).to_pylist()


def _run(transport, group: list[dict]) -> Iterator[pa.RecordBatch]:
    """Fetch one range, decode its tiles, and cut the parts of their requests."""
    parts = _Parts()
    stats = dict.fromkeys(_COUNTED, 0)
    first = group[0]

    def fetch(start: int, length: int) -> bytes:
        found = checked(as_range(transport.get_range(first["key"], start, length)), first["object_size"], first["identity"], first["key"])
        stats["requests"] += found.attempts
        stats["retries"] += found.attempts - 1
        stats["bytes"] += len(found.data)
        return found.data

    try:
        data = b""
        if first["group_id"] >= 0:
            data = fetch(first["g_start"], first["g_length"])
            stats["groups"] += 1
            stats["extra_bytes"] += first["extra_bytes"]
        for job in group:
            stats["blocks"] += 1
            stats["whole_bytes"] += job["bytecount"]
            _job(job, data, fetch, parts, stats)
    except (TransportError, Unsupported) as e:
        # all or nothing for every request that the range was for
        error = f"{type(e).__name__}: {e}"
        parts = _Parts()
        for r in sorted({i["req_id"] for job in group for i in _items(job)}):
            parts.append({"req_id": r, "error": error})
    yield from parts.all(stats)


def _part(item: dict, values: np.ndarray) -> dict:
    return {"req_id": item["req_id"], "dy0": item["dy0"], "dx0": item["dx0"], "h": values.shape[0], "w": values.shape[1], "dtype": str(values.dtype), "data": values.tobytes(), "value": float(values.flat[0])}


def _job(job: dict, data: bytes, fetch, parts: _Parts, stats: dict) -> None:
    bw, size = job["blockw"], job["itemsize"]
    row_bytes = bw * size
    if not job["bytecount"]:
        for i in _items(job):
            parts.append(_part(i, np.full((i["ly1"] - i["ly0"], i["lx1"] - i["lx0"]), job["fill"]).astype(job["dtype"])))
        return
    at = job["start"] - job["g_start"]
    have = data[at : at + job["prefix"]]
    end = job["offset"] + job["bytecount"]
    base = job["p_out"] if job["p_out"] is not None else 0
    need = (job["deep"] + 1) * row_bytes - base

    def decode(raw: bytes) -> bytes:
        if job["p_out"] is not None:
            return inflate_at(raw, job["p_bits"], job["p_window"], need)
        if not is_wrapped(raw):
            raise CorruptObject(f"{job['key']}: block {job['block']} is not a zlib stream")
        return inflate_prefix(raw, need)

    out = decode(have)
    if len(out) < need and job["start"] + job["prefix"] < end:
        stats["undershoots"] += 1
        rest = job["start"] + job["prefix"]
        out = decode(have + fetch(rest, end - rest))
    if len(out) < need:
        raise CorruptObject(f"{job['key']}: block {job['block']} ends early")
    if job["p_out"] is not None:
        stats["restarted"] += 1
        stats["window_bytes"] += len(job["p_window"])
    top = job["shallow"]
    rows = np.frombuffer(out, np.uint8)[top * row_bytes - base : need].reshape(-1, row_bytes)
    values = undo_predictor(rows, job["dtype"], bw, job["predictor"])
    for i in _items(job):
        parts.append(_part(i, np.ascontiguousarray(values[i["ly0"] - top : i["ly1"] - top, i["lx0"] : i["lx1"]])))
