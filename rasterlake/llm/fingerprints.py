"""Document fingerprints: a canonical exact digest.

The canonical text is NFKC, case-folded, NFKC again, with each run of white space as one blank and
none at the ends; its digest is 128 bits of xxh3.  Texts with equal digests, edited ones too, are
compared byte by byte; if they differ after all, all but the first get a suffix, so equal
fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialize, maybe_in, text_of, tidy

BITS = 23  # of the filter that tells which digests occur once


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, other: str | None) -> str:
    """The last quarter of the text replaced by as many characters, or all, of the other's start."""
    n = len(text) // 4
    return text[: len(text) - n] + (other or "")[:n]


def _row(doc, text: str, after_id, after: str, make: Callable[[bytes], str], ranks: dict) -> tuple:
    change = edited(text, after)
    own, new, following = canonical(text), canonical(change), canonical(after)

    def name(canon: bytes) -> str:
        found = make(canon)
        rank = ranks.get((found, hashlib.sha256(canon).hexdigest()), 0) if ranks else 0
        return f"{found}-{rank}" if rank else found

    return doc, len(text), hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), name(own), name(new), float(own == new), float(own == following), after_id


_SHAPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
_NAMES = [x.split()[0] for x in _SHAPE.split(", ")]


def _batch(rows: list[tuple], more: list[tuple] | None = None, names: tuple = (), kinds: tuple = ()) -> pa.RecordBatch:
    cols = list(zip(*[(*r, *m) for r, m in zip(rows, more or [()] * len(rows))])) if rows else [()] * (len(_NAMES) + len(names))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*_KINDS, *kinds))], names=[*_NAMES, *names])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: Callable[[bytes], str] = digest, ranks: dict | None = None) -> DataFrame:
    """Digests of each text, of its edited text, whether they and the next text's are equal, and the next id.

    ranks: suffixes by (digest, sha256 of the canonical text).

    The texts are put in order by ranges of the id, once; the first and last row of each range
    then meet those of the ranges beside it.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    extra, kinds = ("part", "end", "text"), (pa.int32(), pa.string(), pa.string())

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        hollow = (0, "", "", "", 0.0, 0.0, None)
        for b in batches(it):
            out, more = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None:
                    out.append((doc, *hollow))
                    more.append((part, "first", text))
                else:
                    out.append(_row(*last, doc, text, make, ranks))
                    more.append((part, None, None))
                last = doc, text
            yield _batch(out, more, extra, kinds)
        if last is not None:
            yield _batch([(last[0], *hollow)], [(part, "last", last[1])], extra, kinds)

    table = materialize(rows.mapInArrow(tidy(run), f"{_SHAPE}, part int, end string, text string"), "ranges")
    ends = table.filter("end is not null")
    # two rows of each range at most; the last range is followed by the first
    order = Window.orderBy("part")
    at = ends.filter("end = 'last'").select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = at.join(ends.filter("end = 'last'").select("part", "doc_id", "text"), "part").join(ends.filter("end = 'first'").select(F.col("part").alias("next"), F.col("doc_id").alias("after_id"), F.col("text").alias("after")), "next")

    def close(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches(it, 16):
            yield _batch([_row(*r, make, ranks) for r in zip(*[c.to_pylist() for c in b.columns])])

    return table.filter("end is null").select(*_NAMES).unionByName(pairs.select("doc_id", "text", "after_id", "after").mapInArrow(tidy(close), _SHAPE))


def collisions(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: Callable[[bytes], str] = digest) -> DataFrame:
    """Canonical texts, edited ones too, that share a digest with another: digest, sha (of the text's bytes), rank from 0.

    table: what neighbours() gave.  Texts whose digest occurs more than once are compared byte by
    byte: each task keeps one copy of each, and of a digest all tasks' copies meet.  Edited texts
    are made again from the two documents that they are made of.  Normally the result is empty.
    """
    digests = table.select(F.explode(F.array("fingerprint", "edited_fingerprint")).alias("digest"))
    size = 1 << BITS
    twice = materialize(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "twice")
    spot = F.conv(F.substring("digest", 1, BITS // 4 + 1), 16, 10).cast("long") % size
    words = twice.select(spot.alias("spot")).groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))).alias("bits")).collect()  # 2 ** BITS bits at most
    bits = np.zeros(size // 64, np.int64)
    for r in words:
        bits[r.word] = r.bits
    bits = bits.view(np.uint64)

    def pick(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        held = 0
        for b in batches(it):
            out = []
            for text, *more in zip(*[c.to_pylist() for c in b.columns]):
                canon = canonical(edited(text, more[0]) if more else text)
                name = make(canon)
                at = int(name[: BITS // 4 + 1], 16) % size
                if not int(bits[at >> 6]) >> (at & 63) & 1 or canon in seen:
                    continue
                held += len(canon)
                if held > 64 << 20:
                    seen, held = {}, len(canon)
                seen[canon] = None
                out.append((name, canon))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["digest", "canon"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    # pairs of ids whose edited text shares its digest; ids that repeat give more texts than needed, which only adds comparisons
    changed = table.join(twice, F.col("edited_fingerprint") == F.col("digest"), "left_semi").select("doc_id", "next_id").distinct()
    changed = materialize(changed, "changed")
    ids = changed.select(F.col("doc_id").alias("_id")).unionByName(changed.select(F.col("next_id").alias("_id")))
    some = maybe_in(texts, "_id", ids)
    first, after = some.select(F.col("_id").alias("_a"), F.col("_text").alias("_first")), some.select(F.col("_id").alias("_b"), F.col("_text").alias("_after"))
    made = changed.join(first, F.col("doc_id").eqNullSafe(F.col("_a"))).join(after, F.col("next_id").eqNullSafe(F.col("_b"))).select("_first", "_after")
    copies = texts.select("_text").mapInArrow(tidy(pick), "digest string, canon binary").unionByName(made.mapInArrow(tidy(pick), "digest string, canon binary"))
    copies = copies.repartition(n, "digest").sortWithinPartitions("digest")

    def unlike(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, kinds = None, []

        def rows():
            shas = sorted(hashlib.sha256(c).hexdigest() for c in kinds) if len(kinds) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([now] * len(shas), pa.string()), pa.array(shas, pa.string()), pa.array(range(len(shas)), pa.int32())], names=["digest", "sha", "rank"])

        for b in batches(it):
            for name, canon in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != now:
                    if len(kinds) > 1:
                        yield rows()
                    now, kinds = name, []
                if canon not in kinds:
                    kinds.append(canon)
        yield rows()

    return copies.mapInArrow(tidy(unlike), "digest string, sha string, rank int")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: Callable[[bytes], str] = digest) -> DataFrame:
    """Fingerprints of every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_id.

    The next document is that of the next larger id (the first after the last); a null id is
    before all others, and rows that repeat an id are in order of their texts.  A null text is
    empty; of a single row the next is itself.  Likeness is 1 for equal canonical texts, else 0.
    A very long text is one row and is worked on whole.  Of an empty table the result is empty.
    Other columns are not looked at, whatever their names.
    """
    table = materialize(neighbours(docs, id_col, text_col, make), "digests")
    clash = materialize(collisions(docs, table, id_col, text_col, make), "collisions")
    if clash.isEmpty():
        return table
    # texts that differ under one digest: of 128 bits, next to none
    ranks = {(r.digest, r.sha): r["rank"] for r in clash.filter("rank > 0").collect()}
    return neighbours(docs, id_col, text_col, make, ranks)
