"""Sparse, batched reads and access-cost analytics over archives of tiled rasters, on Spark."""

from .model import CorruptObject, ObjectChanged, Options, StaleSidecar, TransportError, Unsupported
from .reader import Lake, Stats
from .sources.catalog import CogIndex, from_index, scan
from .sources.restart import Sidecar
from .sources.tiff import describe
from .sources.transport import FileTransport, HttpTransport, Range

__all__ = ["CogIndex", "CorruptObject", "FileTransport", "HttpTransport", "Lake", "ObjectChanged", "Options", "Range", "Sidecar", "StaleSidecar", "Stats", "TransportError", "Unsupported", "describe", "from_index", "scan"]
