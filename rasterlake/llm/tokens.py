"""Token ids of every document, in files compressed by a range asymmetric numeral system.

One frequency table, counted over all documents, serves every file.  A file has blocks of up to
BLOCK ids that decode on their own; within a block, LANES coders take turns (id i belongs to
coder i mod lanes), so that numpy works on all of them at once.  Blocks hold checkpoints, the
coders' states and place in the stream at every EVERY-th step; the stretches between them are
decoded side by side, as so many more lanes.  Each block has a checksum of its ids.

File layout, little-endian: magic, u32 table checksum, u32 part, u64 ids of the part before this
file, u32 documents, u64 ids, u32 blocks, u32 bytes of the directory; the directory (zlib: i64
document ids, u8 id-is-null, u32 ids of each); blocks.  Block: u32 ids, u32 lanes, u32 words,
u32 checkpoints, u32 crc32 of the ids (u32 each); first states (u64 each); checkpoints (u32
step, u32 words before it, states); words (u32).  A part is a range of document ids; its files
are in order of their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, drop, keep_until_exit, materialize, open_folder, shared_dir, text_of, tidy

BITS = 20  # of the frequency table's sum
BLOCK, LANES, EVERY = 1 << 20, 2048, 128
LOW = 1 << 31  # states are in LOW .. LOW << 32
MAGIC = b"IDANS2\0\0"
_HEAD = "<2IQIQ2I"
PIECES_KEPT = 600_000  # pieces of a worker's cache, some 120 MB


class Table:
    """Frequencies scaled to 1 << BITS, 1 at least for each id that occurs."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.float64)
        used = np.flatnonzero(counts)
        if len(used) > 1 << BITS:
            raise ValueError("more ids than slots")
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            spare = (1 << BITS) - len(used)
            exact = counts[used] * (spare / counts[used].sum())
            freq[used] = 1 + np.floor(exact).astype(np.int64)
            short = (1 << BITS) - int(freq.sum())
            freq[used[np.lexsort((used, np.floor(exact) - exact))[:short]]] += 1  # largest remainders
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def _encode_block(ids: np.ndarray, t: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, marks = [None] * steps, []
    bits, half, low32 = np.uint64(BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    for k in range(steps - 1, -1, -1):
        sym = ids[k * lanes : (k + 1) * lanes]
        y, f = x[: len(sym)], t.freq[sym]
        full = y >= f << np.uint64(63 - BITS)
        words[k] = (y[full] & low32).astype("<u4")
        y = np.where(full, y >> half, y)
        q = y // f
        x[: len(sym)] = (q << bits) + (y - q * f) + t.start[sym]
        if k and k % EVERY == 0:
            marks.append((k, x.copy()))
    at = np.cumsum([0, *map(len, words)])
    out = [struct.pack("<5I", n, lanes, int(at[-1]), len(marks), zlib.crc32(ids.astype("<u4").tobytes())), x.astype("<u8").tobytes()]
    for k, state in reversed(marks):
        out += [struct.pack("<2I", k, int(at[k])), state.astype("<u8").tobytes()]
    return b"".join([*out, *[w.tobytes() for w in words]])


def _step(x: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that states hold, the states without them, and which of those need a word."""
    slot = x & np.uint64((1 << BITS) - 1)
    sym = t.id_of[slot]
    y = t.freq[sym] * (x >> np.uint64(BITS)) + slot - t.start[sym]
    return sym, y, y < LOW


def decode_block(data: bytes, t: Table, at: int = 0, from_step: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at a byte offset, and the offset after it.

    Stretches between checkpoints decode side by side.  With from_step, which must be a
    checkpoint's, only the ids from that step on.  Raises ValueError if the ids don't have the
    block's checksum.
    """
    n, lanes, n_words, n_marks, crc = struct.unpack_from("<5I", data, at)
    at += 20
    steps, words, states = [0], [0], [np.frombuffer(data, "<u8", lanes, at)]
    at += 8 * lanes
    for _ in range(n_marks):
        step, before = struct.unpack_from("<2I", data, at)
        steps.append(step)
        words.append(before)
        states.append(np.frombuffer(data, "<u8", lanes, at + 8))
        at += 8 + 8 * lanes
    stream = np.append(np.frombuffer(data, "<u4", n_words, at).astype(np.uint64), np.uint64(0))
    first = steps.index(from_step)
    base, half = from_step * lanes, np.uint64(32)
    out = np.empty(n - base, dtype=np.uint32)
    # whole stretches together: row k of x is the state of the coders in stretch first + k
    many = len(steps) - 1 - first
    if many:
        x, word = np.stack(states[first:-1]).astype(np.uint64), np.array(words[first:-1], np.int64)
        shaped = out[: many * EVERY * lanes].reshape(many, EVERY, lanes)
        for k in range(EVERY):
            shaped[:, k], x, need = _step(x, t)
            place = np.cumsum(need, 1)
            fill = stream[np.minimum(word[:, None] + place - 1, n_words)]
            x = np.where(need, (x << half) | fill, x)
            word += place[:, -1]
    x, word = states[-1].astype(np.uint64), words[-1]
    for lo in range(steps[-1] * lanes, n, lanes):
        m = min(lanes, n - lo)
        out[lo - base : lo - base + m], y, need = _step(x[:m], t)
        count = int(need.sum())
        y[need] = (y[need] << half) | stream[word : word + count]
        word += count
        x[:m] = y
    if from_step == 0 and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return out, at + 4 * n_words


def encode_file(doc_ids: list, ids: list[np.ndarray], t: Table, part: int = 0, before: int = 0) -> bytes:
    """One file of documents in order; doc_ids may hold None."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    head = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array([len(x) for x in ids], "<u4").tobytes()])
    head = zlib.compress(head, 1)
    blocks = [_encode_block(flat[i : i + BLOCK], t) for i in range(0, len(flat), BLOCK)]
    return b"".join([MAGIC, struct.pack(_HEAD, t.crc, part, before, len(doc_ids), len(flat), len(blocks), len(head)), head, *blocks])


def decode_file(data: bytes, t: Table) -> tuple[list, np.ndarray, np.ndarray, int, int]:
    """Document ids, each one's number of ids, all ids, the part, and ids of the part before.  Raises ValueError for another table's file."""
    crc, part, before, docs, n, blocks, size = struct.unpack_from(_HEAD, data, 8)
    if data[:8] != MAGIC or crc != t.crc:
        raise ValueError("not a file of this table")
    at = 8 + struct.calcsize(_HEAD)
    head = zlib.decompress(data[at : at + size])
    at += size
    doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(head, "<i8", docs), head[8 * docs : 9 * docs])]
    parts = []
    for _ in range(blocks):
        own, at = decode_block(data, t, at)
        parts.append(own)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(flat) != n:
        raise ValueError("a file's ids are not all there")
    return doc_ids, np.frombuffer(head, "<u4", docs, 9 * docs), flat, part, before


_cached: dict[str, Encoder] = {}
# The pattern by which the default tokenizer splits texts, and the same for Python's
# re over the characters of _KNOWN.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_KNOWN = "\t\n\r" + "".join(chr(c) for a, z in ((32, 126), (0xA1, 0xAC), (0xAE, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC)) for c in range(a, z + 1))


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    The library's own splitting of texts takes most of its time, and the pieces recur.  So texts
    whose characters are all in _KNOWN are split by the tokenizer's pattern in Python's re, and
    the library's model encodes each new piece; its ids are kept while the worker lives.  All
    other texts, and all texts of a tokenizer that splits otherwise, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        spec = json.loads(Path(path).read_text())
        self.added = [a["content"].lower() for a in spec.get("added_tokens", [])]
        # printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.known = re.compile(f"[{re.escape(_KNOWN)}]*") if self._splits(spec) else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _cached:
            _cached[path] = cls(path)
        return _cached[path]

    def _splits(self, spec: dict) -> bool:
        """Does the tokenizer do what _PIECE does, for every character of _KNOWN beside letters, digits and marks?"""
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if pre[0].get("pattern") != {"Regex": _SPLIT} or spec["model"]["type"] != "BPE" or spec.get("post_processor"):
            return False
        probe = [f"a{c}b {c}{c} 1{c}2 .{c}, '{c}" for c in _KNOWN]
        return all(got.tokens == [t.value for w in _PIECE.findall(x.lower()) for t in self.tok.model.tokenize(self._mapped(w))] for x, got in zip(probe, self.tok.encode_batch(probe, add_special_tokens=False)))

    def _mapped(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))

    def encode(self, texts: list[str], last: int | None = None) -> list[np.ndarray]:
        end = b"" if last is None else struct.pack("<I", last)
        if len(self.ids) > PIECES_KEPT:
            self.ids = dict(islice(self.ids.items(), PIECES_KEPT // 4))
        ids, get, tokenize = self.ids, self.ids.get, self.tok.model.tokenize
        out: list = []
        for text in texts:
            low = text.lower() if self.known is not None and self.known.fullmatch(text) else None
            if low is None or any(a in low for a in self.added):
                out.append(None)
                continue
            pieces = _PIECE.findall(low)
            got = list(map(get, pieces))
            if None in got:
                for k, x in enumerate(got):
                    if x is None:
                        w = pieces[k]
                        got[k] = get(w)
                        if got[k] is None:
                            got[k] = ids[w] = array("I", [t.id for t in tokenize(self._mapped(w))]).tobytes()
            got.append(end)
            out.append(np.frombuffer(b"".join(got), "<u4"))
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, self.tok.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            out[i] = np.frombuffer(np.array(e.ids, "<u4").tobytes() + end, "<u4")
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _pack(x: np.ndarray) -> bytes:
    """Ids for the time between two passes."""
    return _zstd().compress(x.astype("<u4" if len(x) and x.max() > 0xFFFF else "<u2").tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, wide: bool) -> np.ndarray:
    raw = _zstd().decompress(data, n * (4 if wide else 2), asbytes=True)
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


PARTS = "part int, chunk int, n_ids long, before long, docs array<long>, sizes array<int>, wide boolean, ids binary, counts binary"


def write_ids(docs: DataFrame, path: str, last: int, size: int, id_col: str = "doc_id", text_col: str = "text", ids_a_file: int = 1 << 20) -> DataFrame:
    """The ids of all documents in ascending order of id, in pieces of at least `ids_a_file` ids (but for the last of a part).

    part and chunk give the order of the pieces, which are rows of a table in the shared folder;
    before: ids of the part before the piece.  counts (of the last piece of a part): how often
    each of `size` ids occurs in the part.  Rows are range-partitioned by id, then by a hash
    of the text, so equal ids spread too.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder, part, chunk = Encoder.of(path), TaskContext.get().partitionId(), 0
        names, ids, held, before, counts = [], [], 0, 0, np.zeros(size, np.int64)

        def flush(end: bool):
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            counts.__iadd__(np.bincount(flat, minlength=size))
            wide = bool(len(flat) and flat.max() > 0xFFFF)
            columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([held], pa.int64()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int32())), pa.array([wide]), pa.array([_pack(flat)], pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1) if end else None], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PARTS.split(", ")])

        for b in batches(it):
            for d, x in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist(), last)):
                names.append(d)
                ids.append(x)
                held += len(x)
                if held >= ids_a_file:
                    yield flush(False)
                    names, ids, held, before, chunk = [], [], 0, before + held, chunk + 1
        if names or chunk:
            yield flush(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # as many partitions as shuffles have: AQE would not split those that repeat an id
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash")
    return materialize(ordered.select("doc_id", "text").mapInArrow(tidy(run), PARTS), "ids")


def count_ids(parts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; at most `size` rows come to the driver."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for b in it:
            for data in b.column(0).to_pylist():
                n += np.frombuffer(zlib.decompress(data), np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["id", "n"])

    rows = parts.filter("counts is not null").select("counts").mapInArrow(tidy(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_files(parts: DataFrame, table: Table, folder: str) -> DataFrame:
    """Each piece of write_ids as a file in `folder`, which all executors reach: part, n_ids, path.

    A file is written under another name and moved, so a task that is tried again, or twice at
    once, leaves the same file.
    """

    def encode(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for b in it:
            for k in range(b.num_rows):
                part, chunk, total, before, names, sizes, wide, data, _ = [c[k].as_py() for c in b.columns]
                ids = np.split(_unpack(data, total, wide), np.cumsum(sizes)[:-1]) if sizes else []
                name = f"part-{part:06d}-{chunk:06d}.ids"
                new = f"{root}/_{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as f:
                    f.write(encode_file(names, ids, table, part, before))
                fs.move(new, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(2).slice(k, 1), pa.array([name])], names=["part", "n_ids", "path"])

    return materialize(parts.mapInArrow(tidy(encode), "part int, n_ids long, path string"), "files")


def read_files(spark: SparkSession, folder: str, table: Table, manifest: DataFrame) -> DataFrame:
    """Decode the files of a folder and place each document: doc_id, start, n_tokens, ids_crc32.

    manifest is what write_files returned; it has the ids of each part, and there are as many
    parts as a shuffle has partitions, so where parts begin is broadcast.  Raises ValueError, in
    the job, for a file that isn't whole.
    """
    part = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("part", F.coalesce(F.sum("in_part").over(order), F.lit(0)).alias("at"))

    def decode(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for data in b.column(0):
                names, sizes, flat, own, before = decode_file(data.as_py(), table)
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), own, np.int32)), pa.array(names, pa.int64()), pa.array(starts + before), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "after", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("content")
    rows = files.mapInArrow(tidy(decode), "part int, doc_id long, after long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part), "part").select("doc_id", (F.col("at") + F.col("after")).alias("start"), "n_tokens", "ids_crc32")


def write(docs: DataFrame, folder: str, path: str | None = None, last: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[Table, DataFrame]:
    """Tokenize docs and write them as files in `folder`: the frequency table and the manifest (part, n_ids, path)."""
    path = path or default_tokenizer()
    size = max(_vocabulary(path), last + 1)
    parts = write_ids(docs, path, last, size, id_col, text_col)
    table = Table(count_ids(parts, size))
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    files = write_files(parts, table, folder)
    drop(parts)
    return table, files


def tokenize(docs: DataFrame, path: str | None = None, last: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write in id order, read back: doc_id, start, n_tokens (with the end id), ids_crc32.

    A null text is empty and has the end id alone.  Null ids come first.  Rows with equal ids
    are neighbours in the order of their texts' hashes, so reruns agree; a very long text is one
    piece, encoded whole.  Rows that repeat are each written.  Of an empty table the result is
    empty.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/files/tokens-{uuid.uuid4().hex}"
    keep_until_exit(spark, folder)
    table, files = write(docs, folder, path, last, id_col, text_col)
    return read_files(spark, folder, table, files)
