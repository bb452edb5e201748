"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of a text; every term of the labelled examples is indexed.  A term weighs
(1 + ln tf) times its idf, counted over all documents, times its relevance to the label, the
square root of one plus chi squared on the examples (supervised term weighting): without that
factor the prose around a few telling words decides which examples are near.

The index has, for each term, the examples with it and their weights.  Lists of terms that few
examples have are added up in full.  For those that many have, only the largest weight in each
block of examples is looked at first: sum and block maxima bound an example's cosine, and only
examples whose bound reaches the k-th best cosine are worked out.  Where bounds leave many, a
product of matrices gives all cosines in single precision, and those that reach the k-th best
but for its error are worked out again in double precision; so the neighbours are exact.
They vote in proportion to cosine, against a prior that counts as one more neighbour; isotonic
regression over the examples' votes, each without itself, makes a vote a probability.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, text_of, tidy

WORD = re.compile(r"\w+")
BLOCK, NEIGHBOURS, PRIOR = 64, 15, 0.25
TEXTS = 128  # searched for at once
MANY = 256  # examples that are cheaper to work out for many texts at once
MOST = 4_000  # labelled rows that are examples
LONG = 1 / 16  # share of the examples from which a term's list counts as long


def term_hash(word: str) -> int:
    """Terms are named by 63 bits of their hash."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


class Model:
    """What fit() has learned: the index in CSR form by term, and the calibration.

    Tasks are sent term numbers and counts only; weights, block maxima and the dense part are
    worked out once in each worker.
    """

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, weight: np.ndarray, prior: float, no_terms: float, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.terms = terms  # sorted hashes; a term's number is its place
        self.idf = idf  # times relevance
        self.ids, self.toxic = ids, toxic  # of the examples
        self.weight = weight  # labelled rows that an example stands for
        self.prior, self.no_terms = prior, no_terms  # the latter is the score of texts without any term
        self.vote_at, self.score_at = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        cols = np.concatenate([np.empty(0, np.int64), *[t for t, _ in vectors]]).astype(np.int64)
        counts = np.concatenate([np.empty(0, np.int64), *[c for _, c in vectors]])
        order = np.lexsort((rows, cols))
        small = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)
        self.rows, self.counts = small(rows[order]), small(counts[order])
        self.cuts = np.searchsorted(cols[order], np.arange(len(terms) + 1)).astype(np.uint32)
        self._made: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def forget(self) -> None:
        """Let go of what index() made: the worker that keeps this model may turn to other work."""
        self._made = None

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' terms and counts."""
        terms = np.repeat(np.arange(len(self.terms)), np.diff(self.cuts.astype(np.int64)))
        order = np.argsort(self.rows, kind="stable")
        ends = np.searchsorted(self.rows[order], np.arange(len(self.ids) + 1))
        return [(terms[order[a:z]], self.counts[order[a:z]]) for a, z in zip(ends, ends[1:])]

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        size = np.sqrt((w * w).sum())
        return w / size if size else w

    def index(self) -> tuple:
        """rows and weights by term, where a term's list begins, its row among long ones (or -1), and of those the
        weights by example, in double and single precision, and the largest by block."""
        if self._made is None:
            n, cuts = len(self.ids), self.cuts.astype(np.int64)
            rows = self.rows.astype(np.int64)
            w = (1 + np.log(self.counts.astype(float))) * np.repeat(self.idf, np.diff(cuts))
            vals = w / np.maximum(np.sqrt(np.bincount(rows, w * w, n)), 1e-300)[rows]
            many = np.flatnonzero(np.diff(cuts) > n * LONG)
            long = np.full(len(self.terms), -1, np.int32)
            long[many] = np.arange(len(many))
            full = np.zeros((-(-n // BLOCK) * BLOCK, len(many)))
            for k, t in enumerate(many):
                full[rows[cuts[t] : cuts[t + 1]], k] = vals[cuts[t] : cuts[t + 1]]
            peak = full.reshape(len(full) // BLOCK, BLOCK, len(many)).max(1)
            self._made = rows, vals, cuts, long, full, full.astype(np.float32), peak
        return self._made

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the k examples of largest cosine (0 excluded; ties: the lower number) and their cosines."""
        out = []
        for at in range(0, len(vectors), TEXTS):
            out += self._nearest(vectors[at : at + TEXTS], k, but[at : at + TEXTS] if but else [-1] * TEXTS)
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        rows, vals, cuts, long, full, full32, peak = self.index()
        n = len(full)
        query = np.zeros((full.shape[1], len(vectors)))
        parts, out, dense = [], [], []
        for j, (terms, counts) in enumerate(vectors):
            q = self.weights(terms, counts)
            row = long[terms]
            few = row < 0
            query[row[~few], j] = q[~few]
            first, ends = cuts[terms[few]], cuts[terms[few] + 1]
            sizes = ends - first
            place = np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            parts.append(np.bincount(rows[place], vals[place] * np.repeat(q[few], sizes), n)[:n])
        bounds = peak @ query
        for j, part in enumerate(parts):
            most = (part.reshape(-1, BLOCK) + bounds[:, j, None]).ravel()
            if but[j] >= 0:
                most[but[j]] = part[but[j]] = 0.0
            low = np.partition(part, n - k)[n - k] if n > k else 0.0
            some = np.flatnonzero((most >= low - 1e-9) & (most > 0))
            if len(some) > MANY:
                dense.append(j)
            out.append(_exact(some, full, part, query[:, j], k) if len(some) <= MANY else None)
        if dense:
            # where bounds leave many: all cosines in single precision, and again those near the k-th or above
            rough = full32 @ query[:, dense].astype(np.float32)
            for g, j in enumerate(dense):
                cos = rough[:, g] + parts[j]
                if but[j] >= 0:
                    cos[but[j]] = 0.0
                low = np.partition(cos, n - k)[n - k] if n > k else 0.0
                some = np.flatnonzero(cos >= max(low - 1e-4, 1e-9))
                out[j] = _exact(some, full, parts[j], query[:, j], k, but[j])
        return out

    def vote(self, best: np.ndarray, cos: np.ndarray) -> float:
        w = cos * self.weight[best]
        own = float(self.weight.mean()) if len(self.weight) else 1.0
        return float(((w * self.toxic[best]).sum() + PRIOR * own * self.prior) / (w.sum() + PRIOR * own))

    def calibrate(self, votes: np.ndarray) -> None:
        """Pool adjacent violators over the examples' votes."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # weighted labels, weight, lowest and highest vote
        for i in order:
            pools.append([self.weight[i] * self.toxic[i], self.weight[i], votes[i], votes[i]])
            while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
                s, w, _, hi = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], hi]
        if not pools:
            return
        at, to = [], []
        own = float(self.weight.mean())
        for s, w, lo, hi in pools:
            p = (s + self.prior * own) / (w + own)  # one neighbour's worth of prior
            at += [lo, hi]
            to += [p, p]
        self.vote_at, self.score_at = np.array(at), np.maximum.accumulate(np.array(to))

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's score, nearest examples and cosines."""
        out = []
        for best, cos in self.nearest(vectors):
            p = float(np.interp(self.vote(best, cos), self.vote_at, self.score_at)) if len(best) else self.no_terms
            out.append((min(1.0, max(0.0, p)), best, cos))
        return out


def _exact(some: np.ndarray, full: np.ndarray, part: np.ndarray, query: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The best k of some examples: part, plus what long terms add."""
    own = np.flatnonzero(query)
    cos = np.round(part[some] + (full[some[:, None], own[None, :]] * query[own]).sum(1), 12)
    kept = (cos > 0) & (some != but)
    some, cos = some[kept], cos[kept]
    top = np.lexsort((some, -cos))[:k]
    return some[top], cos[top]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _lists(columns: list[pa.Array], names: list[str], ends: list[int], lists: dict[str, pa.Array]) -> pa.RecordBatch:
    cut = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(cut, x) for x in lists.values()]], names=[*names, *lists])


def _rows_of(b: pa.RecordBatch, *names: str) -> list[list[np.ndarray]]:
    """The rows of list columns as arrays."""
    out = []
    for name in names:
        c = b.column(name)
        ends, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out.append([flat[a:z] for a, z in zip(ends[:-1], ends[1:])])
    return out


_planes = lambda x: x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def pack(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers and their counts, for the time between two passes."""
    return struct.pack("<I", len(terms)) + pa.Codec("zstd", compression_level=1).compress(_planes(np.diff(terms, prepend=0)) + _planes(counts), asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 8 * n, asbytes=True), np.uint8).reshape(2, 4, n)
    both = np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


def example_vectors(examples: DataFrame, most: int) -> pa.Table:
    """_id, _y, terms (hashes), counts of the rows (_id, _y, _text): one row an id, `most` at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches(it):
            ends, names, counts, key = [0], [], [], []
            for text in b.column(2).to_pylist():
                own = sorted(Counter(WORD.findall(text.lower())).items())
                names += [term_hash(w) for w, _ in own]
                counts += [n for _, n in own]
                ends.append(len(names))
                key.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
            yield _lists([*b.columns[:2], pa.array(key, pa.int64())], ["_id", "_y", "key"], ends, {"terms": pa.array(names, pa.int64()), "counts": pa.array(counts, pa.int32())})

    rows = examples.select("_id", "_y", "_text").mapInArrow(tidy(run), "_id long, _y int, key long, terms array<long>, counts array<int>")
    one = rows.groupBy("_id").agg(F.max_by(F.struct("_y", "terms", "counts"), "key").alias("v"))
    return one.select("_id", "v.*").orderBy("_id").limit(most).toArrow()


def vectors(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs' other columns with `vector`, the known terms of each whole text and their counts (pack).

    After its rows a task gives one row more, without those columns, whose vector is how many of
    its texts have each term (int32 each, by zlib); `is_count` tells.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, int] = {}
        size = max(1, len(terms))
        df = np.zeros(size, np.int32)
        shape = None
        for b in batches(it):
            shape = b.schema
            words, ends = [], [0]
            for text in b.column(b.num_columns - 1).to_pylist():
                words += WORD.findall(text.lower())
                ends.append(len(words))
            if len(known) > 200_000:
                known.clear()
            new = list(set(words).difference(known))
            if new:
                h = np.fromiter(map(term_hash, new), np.int64, len(new))
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                known.update(zip(new, np.where(terms[at] == h, at, -1).tolist() if len(terms) else [-1] * len(new)))
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            key, counts = np.unique((row * size + ids)[ids >= 0], return_counts=True)
            row, ids = np.divmod(key, size)
            df += np.bincount(ids, minlength=size).astype(np.int32)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            packed = [pack(ids[x:y], counts[x:y]) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([False] * b.num_rows), pa.array(packed, pa.binary())], names=[*b.schema.names[:-1], "is_count", "vector"])
        if shape is not None:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in shape.types[:-1]], pa.array([True]), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], names=[*shape.names[:-1], "is_count", "vector"])

    keep = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, text_of(text_col).alias(text_col)).mapInArrow(tidy(run), f"{schema}, is_count boolean, vector binary")


def summed(counts: DataFrame, size: int, tasks: int = 8) -> np.ndarray:
    """The sum of the count rows of vectors(): added up where they lie, then in `tasks` tasks, whose arrays come to the driver."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, some = np.zeros(size, np.int64), False
        for b in it:
            for data, wide in zip(b.column(0), b.column(1).to_pylist()):
                n += np.frombuffer(zlib.decompress(data.as_py()), np.int64 if wide else np.int32)[:size]
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(n.tobytes(), 1)], pa.binary()), pa.array([True])], names=["vector", "wide"])

    shape = "vector binary, wide boolean"
    parts = counts.select("vector", F.lit(False).alias("wide")).mapInArrow(tidy(add), shape).repartition(tasks)
    out = np.zeros(size, np.int64)
    for r in parts.mapInArrow(tidy(add), shape).collect():
        out += np.frombuffer(zlib.decompress(r.vector), np.int64)
    return out


def relevance(counts: np.ndarray, toxic: np.ndarray, clean: int, bad: int) -> np.ndarray:
    """sqrt(1 + chi squared) of each term: counts, of which toxic, among `clean` and `bad` examples."""
    n = clean + bad
    other = counts - toxic
    odd = (toxic * (clean - other) - other * (bad - toxic)).astype(float) ** 2 * n
    return np.sqrt(1 + odd / np.maximum(1.0, counts.astype(float) * (n - counts) * clean * bad))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> tuple[Model | None, DataFrame, Broadcast | None]:
    """Learn from labelled rows; also gives each row's terms: (model,
    table of doc_id, held_out, vector, the model as sent to tasks).

    Labels come from ids that aren't held out only, and of those from a bounded sample: `most`
    rows, by a hash of the id, a third of them toxic where there are enough; an example weighs
    as many labelled rows as it stands for.  All terms of the examples are indexed; how many
    documents have them is counted over all rows of docs.  An id that repeats in docs is one
    example (its text of largest hash); one that repeats in labels is toxic if any row says so.
    Without a label of either kind there is no model.
    """
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    y = y.groupBy("_id").agg(F.max("_y").alias("_y")).filter(~held_out("_id"))
    totals = {r._y: r.n for r in y.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"))
        return None, rows.select("*", F.lit(None).cast("binary").alias("vector")), None
    parts = [y.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((1, most // 3), (0, most - most // 3))]
    sample = parts[0].unionByName(parts[1])
    # at most `most` rows of twelve bytes
    examples = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    found = example_vectors(examples.select(F.col("_id").cast("long").alias("_id"), "_y", "_text"), most)
    names, counts = ([np.empty(0, np.int64)] * found.num_rows for _ in range(2))
    if found.num_rows:
        names, counts = _rows_of(found.combine_chunks().to_batches()[0], "terms", "counts")
    toxic = np.array(found.column("_y").to_pylist(), float)
    terms = np.unique(np.concatenate([np.empty(0, np.int64), *names]))
    vecs = []
    for h, c in zip(names, counts):
        order = np.argsort(h)
        vecs.append((np.searchsorted(terms, h[order]).astype(np.int32), c[order]))
    # every text keeps all its known terms
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    table = materialize(vectors(rows, terms, "_text"), "toxic")
    df = np.maximum(1, summed(table.filter("is_count"), len(terms)))
    table = table.filter("not is_count").select("doc_id", "held_out", "vector")
    all_rows = table.count()
    has = [np.bincount(np.concatenate([np.empty(0, np.int32), *[t for (t, _), own in zip(vecs, toxic) if own in kinds]]).astype(np.int64), minlength=len(terms)) for kinds in ((0, 1), (1,))]
    idf = np.log1p(all_rows / df) * relevance(*has, int((toxic == 0).sum()), int((toxic == 1).sum()))
    weigh = {k: totals[k] / max(1, int((toxic == k).sum())) for k in (0, 1)}
    prior = totals[1] / (totals[0] + totals[1])
    weight = np.array([weigh[int(k)] for k in toxic])
    some = np.array([len(t) > 0 for t, _ in vecs], bool)
    silent = float((weight * toxic)[~some].sum() + prior) / float(weight[~some].sum() + 1) if len(some) else prior
    model = Model(terms, idf, np.array(found.column("_id").to_pylist(), np.int64)[some], toxic[some], weight[some], prior, silent, [v for v, own in zip(vecs, some) if own])
    # its size is bounded by the examples
    sent = docs.sparkSession.sparkContext.broadcast(model)
    if some.any():
        model.calibrate(_own_votes(docs, sent, len(model.ids)))
    return model, table, sent


def _own_votes(docs: DataFrame, sent: Broadcast, n: int) -> np.ndarray:
    """The vote on each example without itself, in tasks: as many numbers come back as there are examples."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = sent.value
        vecs = model.vectors()
        for b in it:
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.vote(*x) for x in model.nearest([vecs[i] for i in own], but=own)], pa.float64())], names=["i", "vote"])

    spark = docs.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 64)))
    out = np.zeros(n)
    for r in spark.range(0, n, 1, tasks).select(F.col("id").alias("i")).mapInArrow(tidy(run), "i long, vote double").collect():
        out[r.i] = r.vote
    return out


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", shown: int = 3, **bounds) -> DataFrame:
    """Toxicity of every row of docs: doc_id, held_out, score, predicted (score >= 0.7), evidence.

    evidence has up to `shown` nearest examples (doc_id, cosine, toxic); of equal cosines the
    lower id is nearer.  Equal texts have equal scores.  A null text is empty; a text without
    known terms, the empty one too, has the rate of toxic labels among such examples.  A very
    long text counts whole.  Without labels of both kinds all scores are that of the only label,
    or 0.  Repeated rows are scored each.  Of an empty table the result is empty.  Other columns
    are not looked at, whatever their names.
    """
    model, table, sent = fit(docs, labels, label_col, id_col, text_col, **bounds)
    shape = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    if model is None:
        one = labels.filter(~held_out(id_col)).agg(F.max(F.col(label_col).cast("double"))).first()[0] or 0.0
        return table.select("doc_id", "held_out", F.lit(float(one)).alias("score"), F.lit(int(one >= 0.7)).alias("predicted"), F.array().cast("array<struct<doc_id:long,cosine:double,toxic:int>>").alias("evidence"))

    at, to = model.vote_at, model.score_at

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = sent.value
        model.vote_at, model.score_at = at, to
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches(it, 4096):
            scores, shown_rows = [], []
            for p, best, cos in model.score([unpack(data.as_py()) for data in b.column(2)]):
                scores.append(p)
                shown_rows.append([{"doc_id": int(model.ids[i]), "cosine": float(x), "toxic": int(model.toxic[i])} for i, x in zip(best[:shown], cos[:shown])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()), pa.array(shown_rows, kind)], names=["doc_id", "held_out", "score", "predicted", "evidence"])
        model.forget()

    # searching costs more than moving a packed row: as many tasks as a shuffle has partitions
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(n).mapInArrow(tidy(run), shape)
