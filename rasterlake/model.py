"""Requests, options, table schemas and errors."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Unsupported(Exception):
    """The request or object is outside what this engine reads; nothing was fetched."""


class TransportError(Exception):
    """Bytes could not be fetched as asked."""


class CorruptObject(TransportError):
    """Compressed bytes that do not decode to a whole tile."""


class ObjectChanged(TransportError):
    """The object is not the one that was described."""


class StaleSidecar(Exception):
    """Restart points of another version of the object, or of an unknown one."""


REQUEST = "req_id long, key string, level int, x int, y int, w int, h int"
LEVEL = "level int, is_mask boolean, width int, height int, blockw int, blockh int, nbx int, nby int, nplanes int, dtype string, itemsize int, samples int, planar int, compression int, predictor int, byteorder string, offsets array<long>, bytecounts array<long>"
OBJECT = f"key string, size long, bigtiff boolean, nodata double, identity string, error string, header_bytes long, transform array<double>, epsg int, levels array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in LEVEL.split(', ')))}>>"


@dataclass(frozen=True)
class Options:
    """How much to fetch and what to refuse; raises ValueError for values out of range."""

    margin: float = 0.03
    min_fetch: int = 16384
    rtt_s: float = 0.05
    bandwidth_mbps: float = 100.0
    workers: int = 1
    max_fetch_bytes: int = 128 << 20
    max_output_bytes: int = 1 << 30
    max_block_bytes: int = 64 << 20

    def __post_init__(self):
        if self.margin < 0 or self.rtt_s < 0 or self.bandwidth_mbps < 0:
            raise ValueError("margin, rtt_s and bandwidth_mbps must not be negative")
        if min(self.min_fetch, self.max_fetch_bytes, self.max_output_bytes, self.max_block_bytes) <= 0:
            raise ValueError("sizes must be positive")
        if isinstance(self.workers, bool) or not isinstance(self.workers, int) or self.workers < 1:
            raise ValueError("workers must be a whole number of at least 1")

    @property
    def merge_budget(self) -> float:
        """Bytes that one more round trip is worth; without a bandwidth, any number."""
        return self.rtt_s * self.bandwidth_mbps * 1e6 / 8 if self.bandwidth_mbps else float("inf")


def normalise(request) -> tuple[str, int, int, int, int, int]:
    """(key, x, y), (key, x, y, w, h) or (key, level, x, y, w, h) as the last."""
    r = tuple(request)
    if len(r) not in (3, 5, 6):
        raise ValueError(f"a request has 3, 5 or 6 parts, not {len(r)}")
    key, *numbers = r
    if not isinstance(key, str) or not key:
        raise ValueError("a key is a string that isn't empty")
    if any(isinstance(n, bool) or not isinstance(n, int) for n in numbers):
        raise ValueError("levels, places and sizes are whole numbers")
    if len(r) == 3:
        return key, 0, *numbers, 1, 1
    return (key, 0, *numbers) if len(r) == 5 else (key, *numbers)


def requests(spark: SparkSession, rows: Iterable) -> DataFrame:
    """Requests in their order: req_id counts from 0."""
    return spark.createDataFrame([(i, *normalise(r)) for i, r in enumerate(rows)], REQUEST)
