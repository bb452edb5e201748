"""Where bytes come from: anything with get_range(path, start, length)."""

from __future__ import annotations

import http.client
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

from ..model import ObjectChanged, TransportError, Unsupported

AGAIN = (408, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Range:
    """Bytes of an object, its size and identity, and how many requests they took."""

    data: bytes
    total: int
    identity: str | None = None
    attempts: int = 1


@dataclass(frozen=True)
class FileTransport:
    """Files under a folder that all executors see."""

    root: str

    def get_range(self, path: str, start: int, length: int) -> Range:
        name = os.path.join(self.root, path)
        try:
            size = os.path.getsize(name)
            with open(name, "rb") as f:
                f.seek(start)
                return Range(f.read(length), size, f"file:{size}:{os.stat(name).st_mtime_ns}")
        except OSError as e:
            raise TransportError(str(e)) from e


@dataclass(frozen=True)
class HttpTransport:
    """Range requests to an HTTP(S) store; one connection is kept for each worker process."""

    base: str
    timeout_s: float = 30.0
    retries: int = 3
    backoff_s: float = 0.25
    headers: tuple[tuple[str, str], ...] = ()
    headers_for: Callable[[str, int, int], dict] | None = None

    def __post_init__(self):
        u = urlsplit(self.base)
        if u.scheme not in ("http", "https") or not u.hostname or u.query or u.fragment or u.username or u.password:
            raise ValueError("the base is an absolute http(s) URL without query, fragment or user")
        if self.timeout_s <= 0 or self.retries < 0 or self.backoff_s < 0:
            raise ValueError("timeout_s must be positive, retries and backoff_s not negative")

    def _ask(self, path: str, headers: dict):
        u = urlsplit(self.base)
        kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
        kept = _connections.get(self.base)
        if kept is None:
            kept = _connections[self.base] = kind(u.hostname, u.port, timeout=self.timeout_s)
        try:
            kept.request("GET", u.path.rstrip("/") + "/" + quote(path.lstrip("/"), safe="/"), headers=headers)
            answer = kept.getresponse()
            return answer, answer.read()
        except (OSError, http.client.HTTPException):
            kept.close()
            _connections.pop(self.base, None)
            raise

    def get_range(self, path: str, start: int, length: int) -> Range:
        end = start + length - 1
        headers = {"Accept-Encoding": "identity", **dict(self.headers), **(self.headers_for(path, start, end) if self.headers_for else {}), "Range": f"bytes={start}-{end}"}
        for attempt in range(self.retries + 1):
            try:
                answer, body = self._ask(path, headers)
            except (OSError, http.client.HTTPException) as e:
                why: Exception = TransportError(f"{path}: {e}")
            else:
                if answer.status == 206:
                    return self._whole(path, answer, body, start, end, attempt + 1)
                why = TransportError(f"{path}: HTTP {answer.status}")
                if answer.status not in AGAIN:
                    raise why
            if attempt < self.retries:
                time.sleep(self.backoff_s * 2**attempt)
        raise why

    @staticmethod
    def _whole(path: str, answer, body: bytes, start: int, end: int, attempts: int) -> Range:
        unit, _, rest = (answer.getheader("Content-Range") or "").partition(" ")
        span, _, total = rest.partition("/")
        first, _, last = span.partition("-")
        if unit != "bytes" or not (first.isdigit() and last.isdigit() and total.isdigit()):
            raise TransportError(f"{path}: no Content-Range")
        expected = min(end, int(total) - 1)
        if int(first) != start or int(last) != expected or len(body) != expected - start + 1:
            raise TransportError(f"{path}: not the range asked for")
        version, tag = answer.getheader("x-amz-version-id"), (answer.getheader("ETag") or "").strip()
        name = f"version-id:{version}" if version and version != "null" else f"etag:{tag}" if tag else None
        return Range(body, int(total), name, attempts)


_connections: dict = {}


def as_range(answer) -> Range:
    """What an own transport returned: a Range, or (bytes, size)."""
    found = answer if isinstance(answer, Range) else Range(*answer)
    if not isinstance(found.data, (bytes, bytearray)):
        raise TypeError("a transport returns bytes")
    return found


def checked(found: Range, size: int, identity: str | None, path: str) -> Range:
    """The range, if it is of the object that was described."""
    if identity and found.identity != identity:
        raise ObjectChanged(f"{path}: identity {found.identity}, was {identity}")
    if found.total != size:
        raise Unsupported(f"{path}: size {found.total}, was {size}")
    return found
