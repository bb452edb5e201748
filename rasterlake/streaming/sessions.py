"""Request logs as streams: capture sessions between markers, first requests of connections, staging."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "source string, record string, ts double, label string, conn string, kind string, resp_body_bytes long"
SESSION = "source string, session long, label string, started double, ended double, requests long, bytes long"
_STATE = "open boolean, session long, label string, started double, last double, requests long, bytes long"
RANKS = ("session_start", "req", "session_end")
_RUN = "source string, n long, at binary, size binary, mark_at array<double>, mark_start array<boolean>, mark_label array<string>"
_RUN_SCHEMA = pa.schema([("source", pa.string()), ("n", pa.int64()), ("at", pa.binary()), ("size", pa.binary()), ("mark_at", pa.list_(pa.float64())), ("mark_start", pa.list_(pa.bool_())), ("mark_label", pa.list_(pa.string()))])


def read_events(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Events from JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).json(path)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, their first bytes before their second ones and so on, and deflated: in order they are small so."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events as a row for each batch and source (_RUN): packed times and bytes of the requests in order of time, and the markers."""
    for b in it:
        rank = pc.fill_null(pc.index_in(b.column("record"), pa.array(RANKS)), -1).to_numpy(zero_copy_only=False)
        ts = pc.fill_null(b.column("ts"), float("nan")).to_numpy(zero_copy_only=False)
        size = pc.fill_null(b.column("resp_body_bytes"), 0).to_numpy(zero_copy_only=False)
        names = b.column("source").dictionary_encode(null_encoding="encode")
        of = names.indices.to_numpy(zero_copy_only=False)
        rows = []
        order = np.lexsort((ts, of))
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            r, m = own[rank[own] == 1], own[(rank[own] == 0) | (rank[own] == 2)]
            if len(r) or len(m):
                rows.append({"source": names.dictionary[of[own[0]]].as_py(), "n": len(r), "at": _packed(ts[r]), "size": _packed(size[r]), "mark_at": ts[m].tolist(), "mark_start": (rank[m] == 0).tolist(), "mark_label": b.column("label").take(pa.array(m)).to_pylist()})
        yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)


def sessions(events: DataFrame) -> DataFrame:
    """Closed sessions (SESSION) of each source: what lies between session_start and session_end, or the next session_start.

    Within a micro-batch a source's events are put in order of ts, markers of the end after
    requests of the same time and those of a start before them; between batches they must
    arrive in order.  Requests outside a session are not counted.

    The events are packed where they are read, to a few bytes for a request; a source's task
    holds its runs packed and its markers, and opens one run at a time.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, n, label, start, last, requests, size = state.get if state.exists else (False, 0, None, 0.0, 0.0, 0, 0)
        packed, marks = [], []
        for p in parts:
            for count, at, sizes, when, starts, labels in p[["n", "at", "size", "mark_at", "mark_start", "mark_label"]].itertuples(index=False):
                if count:
                    packed.append((at, sizes))
                marks.extend(zip(when, starts, labels))
        when, starts = np.array([m[0] for m in marks], float), np.array([m[1] for m in marks], bool)
        order = np.lexsort((~starts, when))
        first, second = np.sort(when[starts]), np.sort(when[~starts])
        # of each stretch before, between and after markers: requests, bytes, time of the last one
        counts, totals, ends = np.zeros(len(marks) + 1, np.int64), np.zeros(len(marks) + 1, np.int64), np.full(len(marks) + 1, np.nan)
        for at, sizes in packed:
            ts, got = _unpacked(at, np.float64), _unpacked(sizes, np.int64)
            place = np.searchsorted(first, ts, "right") + np.searchsorted(second, ts, "left")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
            to = np.append(cut[1:], len(ts))
            counts[place[cut]] += to - cut
            totals[place[cut]] += np.add.reduceat(got, cut)
            ends[place[cut]] = np.fmax(ends[place[cut]], ts[to - 1])
        out = []
        for k in range(len(marks) + 1):
            if is_open and counts[k]:
                requests, size, last = requests + int(counts[k]), size + int(totals[k]), float(ends[k])
            if k == len(marks):
                break
            ts, is_start, name = marks[order[k]]
            if is_open:
                out.append((key[0], n, label, start, ts, requests, size))
            is_open = bool(is_start)
            if is_open:
                n, label, start, last, requests, size = n + 1, name, ts, ts, 0, 0
        state.update((is_open, n, label, float(start), float(last), requests, size))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])

    slim = events.select("source", "record", "ts", "label", "resp_body_bytes").filter(F.col("record").isin(*RANKS))
    return slim.mapInArrow(_runs, _RUN).groupBy("source").applyInPandasWithState(run, SESSION, _STATE, "append", GroupStateTimeout.NoTimeout)


def new_connections(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first request of each connection of a session; state is kept for `late` of event time."""
    timed = events.filter("record = 'req'").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["source", "label", "conn"])


def traffic(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and bytes by kind in windows of time."""
    timed = events.filter("record = 'req'").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("requests"), F.sum("resp_body_bytes").alias("bytes")).select(F.col("w.start").alias("start"), "kind", "requests", "bytes")


def stage(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Take in the files of a folder that have come since the last call: path, size and SHA-256 of each, appended to `target` as Parquet."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
