"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five words in a row; its weight is how often the text has it (tf) times the mean idf
of its words, idf being 1 + ln(documents / documents with the word).  Words are counted over all
documents.  Of those in less than a share FREQUENT of them all have the idf of that share, so the
table that every task gets has at most (words of a text) / FREQUENT entries, whatever the size of
the corpus; in a corpus of up to 1 / FREQUENT documents every word has its own.

Each text has BANDS x ROWS consistent samples; two texts agree in one with a chance equal to
their weighted Jaccard similarity.  Texts that agree in a whole band meet in a bucket, where the
share of samples that agree tells whether they may be alike.  What is left are families of texts
that may be alike; within them the exact similarity decides.

A group (bucket or family) of up to a block is compared in one task.  A larger one is cut into
blocks, and some HUBS of its rows, drawn by a hash, go to every block.  Rows that links lead to
from the hubs' largest class are done, as links among them would join nothing new; the rest, if
any, meet all rows of the group, by pairs of blocks.  So no pair that could join two classes goes
unseen, and a large group of copies costs its rows times the hubs, not their square.  Tasks
return links that span what they found, not all pairs, so results grow with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, maybe_in, text_of, tidy
from .components import components

WORD = re.compile(r"\w+")
SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 5
SLACK = 4.0  # standard deviations that the share of equal samples may be below LEAST
FREQUENT = 1 / 8192
RARE = 1 + float(np.log(1 / FREQUENT))  # idf of the words below that share
BUCKET_BLOCK, FAMILY_BLOCK = 1024, 512
HUBS = 32  # on average, of a group of more than a block
_TABLE = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Weighted shingles of texts, under one table of word weights."""

    def __init__(self, idf: dict[int, float]):
        self.idf = idf
        self.known: dict[str, tuple[int, float]] = {}

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known, idf = self.known, self.idf
        if len(known) > 300_000:
            known.clear()
        found = WORD.findall(text.lower())
        out = []
        for w in found:
            x = known.get(w)
            if x is None:
                h = word_hash(w)
                x = known[w] = (h, idf.get(h - (1 << 64) if h >> 63 else h, RARE))
            out.append(x)
        return np.array([h for h, _ in out], np.uint64), np.array([v for _, v in out], np.float64)

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Sorted distinct shingles, their weights, and a digest of the words in order.

        A text of one to four words is one shingle.  Without words, the digest is the text's own.
        """
        h, v = self.words(text)
        if not len(h):
            return h, v, xxhash.xxh3_128_digest(b"\0" + text.encode("utf-8", "surrogatepass"))
        n = min(SHINGLE, len(h))
        s, w = np.zeros(len(h) - n + 1, np.uint64), np.zeros(len(h) - n + 1)
        for i in range(n):
            s = s * _MIX + (h[i : len(h) - n + 1 + i] ^ (h[i : len(h) - n + 1 + i] >> np.uint64(29)))
            w += v[i : len(h) - n + 1 + i]
        s ^= s >> np.uint64(31)
        s, first, count = np.unique(s, return_index=True, return_counts=True)
        return s, count * (w[first] / n), xxhash.xxh3_128_digest(h.tobytes())


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def _random_tables(k: int, seed: int = 1):
    """An odd multiplier for each sample; draws of r and of ln c, with 512 more so that all are positive and their bits sort as they do."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    r = rng.gamma(2.0, 1.0, 1 << _TABLE).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, 1 << _TABLE)).astype(np.float32)
    return odd, np.maximum(r, np.float32(1e-6)), c + np.float32(512)


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k consistent samples (u32) of each run of shingles that begins at one of `starts`.

    For a shingle s of weight w: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1), with
    r and c from Gamma(2, 1), b from (0, 1), all given by s; the sample is (s, t) of least a.
    """
    odd, big_r, big_c = _random_tables(k)
    n, lnw = len(shingles), np.log(weights).astype(np.float32)
    out = np.empty((len(starts), k), np.uint32)
    # buffers, so that no array is made anew for each sample
    x, at, key = (np.empty(n, np.uint64) for _ in range(3))
    r, c, b, t = (np.empty(n, np.float32) for _ in range(4))
    name, low, half = np.empty(n, np.uint32), x.view(np.uint32)[::2], key.view(np.uint32).reshape(n, 2)
    for i in range(k):
        np.multiply(shingles, odd[i], out=x)
        np.right_shift(x, np.uint64(64 - _TABLE), out=at)
        big_r.take(at.view(np.int64), out=r, mode="wrap")
        np.right_shift(x, np.uint64(64 - 2 * _TABLE), out=at)
        np.bitwise_and(at, np.uint64((1 << _TABLE) - 1), out=at)
        big_c.take(at.view(np.int64), out=c, mode="wrap")
        np.bitwise_and(low, np.uint32((1 << 24) - 1), out=name)
        np.multiply(name, np.float32(2.0**-24), out=b, casting="unsafe")
        np.divide(lnw, r, out=t)
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += np.float32(1)
        b *= r
        c -= b
        name[:] = t.astype(np.int32).view(np.uint32)
        name *= np.uint32(0x9E3779B9)
        name += low
        half[:, 0], half[:, 1] = name, c.view(np.uint32)
        out[:, i] = np.minimum.reduceat(key, starts).astype(np.uint32)
    return out


def word_weights(docs: DataFrame, text_col: str = "text") -> dict[int, float]:
    """idf of the words in at least FREQUENT of all documents; the rest have RARE.  Keys are signed word hashes."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n: dict[str, int] = {}
        total = 0

        def flush():
            hashes = np.array([word_hash(w) for w in n] or [], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(n.values()), pa.int64()), pa.array(np.zeros(len(n), np.int8))], names=["word", "n", "all"])

        for b in batches(it):
            for text in b.column(0).to_pylist():
                total += 1
                for w in set(WORD.findall(text.lower())):
                    n[w] = n.get(w, 0) + 1
            if len(n) > 500_000:
                yield flush()
                n = {}
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64()), pa.array([1], pa.int8())], names=["word", "n", "all"])

    counts = materialize(docs.select(text_of(text_col)).mapInArrow(tidy(count), "word long, n long, all byte").groupBy("word", "all").agg(F.sum("n").alias("n")), "words")
    total = counts.filter("all = 1").agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}
    rows = counts.filter((F.col("all") == 0) & (F.col("n") >= total * FREQUENT)).collect()  # see FREQUENT
    return {r.word: 1 + float(np.log(total / r.n)) for r in rows}


def signed(docs: DataFrame, idf: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, same (digest of the words), bands (array of long), mark (a byte of each sample); no rows for null ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        make = Shingler(idf)
        for b in batches(it, 48):
            parts = [make.shingles(t) for t in b.column(1).to_pylist()]
            some = [i for i, p in enumerate(parts) if len(p[0])]
            bands: list = [None] * len(parts)
            marks: list = [b""] * len(parts)
            if some:
                sizes = np.array([len(parts[i][0]) for i in some])
                got = samples(np.concatenate([parts[i][0] for i in some]), np.concatenate([parts[i][1] for i in some]), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                keys = np.zeros((len(some), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = (keys ^ got[:, j::ROWS].astype(np.uint64)) * _MIX
                    keys ^= keys >> np.uint64(32)
                keys += np.arange(BANDS, dtype=np.uint64) * _MIX
                for row, i in enumerate(some):
                    bands[i], marks[i] = keys[row].view(np.int64), (got[row] >> np.uint32(24)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[2] for p in parts], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "same", "bands", "mark"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(tidy(run), "doc_id long, same binary, bands array<long>, mark binary")


def star(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows with `i`, `j`, `side`, dealt by (key, i, j): each block of a group, and its hubs ahead of it (side 0).

    rows: n is how many their group has.  A group of up to a block has j 0 and no hubs; else j is -1.  Rows
    are dealt to ceil(n / block) blocks by a hash of the id; a hub is also a row of its block.
    """
    out = rows.withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    draw = lambda seed: F.xxhash64(F.col("doc_id"), F.lit(seed))
    many = F.col("_blocks") > 1
    hub = many & (F.pmod(draw(11), F.lit(1 << 30)) < F.lit(float(HUBS << 30)) / F.col("n"))
    own = F.struct(F.pmod(draw(7), F.col("_blocks")).cast("int").alias("i"), F.lit(1).alias("side"))
    every = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.struct(i.alias("i"), F.lit(0).alias("side")))
    out = out.withColumn("_at", F.explode(F.when(hub, F.concat(every, F.array(own))).otherwise(F.array(own))))
    return _dealt(out.select(*rows.columns, F.col("_at.i").alias("i"), F.when(many, -1).otherwise(0).alias("j"), F.col("_at.side").alias("side")), key)


def crossed(rows: DataFrame, rest: DataFrame, key: str, block: int) -> DataFrame:
    """rows of groups that have a rest, with `i`, `j`, `side`, dealt by (key, i, j): block j of the rest (side 0) and block i of all rows.

    rest: key, doc_id.
    """
    sizes = rest.groupBy(key).agg(F.count("*").alias("_rest"))
    draw = lambda seed, n: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col(n)).cast("int")
    count = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    all_rows = rows.join(sizes, key).withColumn("_i", count("n")).withColumn("_j", count("_rest"))
    left = all_rows.join(rest, [key, "doc_id"], "left_semi").withColumn("j", draw(13, "_j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_i") - 1))).withColumn("side", F.lit(0))
    right = all_rows.withColumn("i", draw(7, "_i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_j") - 1))).withColumn("side", F.lit(1))
    names = [*rows.columns, "i", "j", "side"]
    return _dealt(left.select(names).unionByName(right.select(names)), key)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j", "side")


def spanned(rows: DataFrame, key: str, block: int, run, tag: str) -> DataFrame:
    """Links (u, v) that span all that are alike within the groups.

    run(iterator) compares dealt rows: see _compared().  Rows that do not hang on the hubs' class
    are compared with all of their group in a second pass.
    """
    first = materialize(star(rows, key, block).mapInArrow(tidy(run), "of long, u long, v long"), tag)
    links = first.filter("of is null").select("u", "v")
    rest = first.filter("of is not null").select(F.col("of").alias(key), F.col("u").alias("doc_id")).distinct()
    if rest.isEmpty():
        return links
    rest = materialize(rest, "rest")
    return links.unionByName(crossed(rows, rest, key, block).mapInArrow(tidy(run), "of long, u long, v long").filter("of is null").select("u", "v"))


def _compared(key: tuple, sides: list[int], ids: list[int], marks: np.ndarray, least: float, alike: Callable[[int, int], bool] | None) -> pa.RecordBatch | None:
    """Links of one task's rows, as (null, u, v), and after hubs (j -1) the rest, as (group, id, null).

    alike(x, y), if given, decides about pairs whose samples agree often enough; pairs that are
    joined already, through others, need no look.
    """
    of, _, j = key
    sets, n_hubs = Sets(len(ids)), sum(s == 0 for s in sides)

    def join(pairs) -> None:
        for x, y in zip(*(p.tolist() for p in pairs)):
            if sets.find(x) != sets.find(y) and (alike is None or alike(x, y)):
                sets.join(x, y)

    rest: list[int] = []
    if len(sides) == n_hubs or n_hubs == 0:
        if j == -1 and n_hubs == 0:  # no row was drawn
            rest = ids
        elif len(ids) > 1 and n_hubs == 0:
            join(_maybe(marks, 0, least))
    elif j == -1:
        join(_maybe(marks[:n_hubs], 0, least))
        roots = [sets.find(x) for x in range(n_hubs)]
        main = max(range(n_hubs), key=lambda x: (roots.count(roots[x]), -x))
        join(_maybe(marks, n_hubs, least))
        rest = [ids[x] for x in range(n_hubs, len(ids)) if sets.find(x) != sets.find(main)]
    else:
        join(_maybe(marks, n_hubs, least))
    to = [(None, ids[sets.find(k)], ids[k]) for k in range(len(ids)) if sets.find(k) != k and ids[sets.find(k)] != ids[k]]
    to += [(of, d, None) for d in rest]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in to], pa.int64()) for c in range(3)], names=["of", "u", "v"]) if to else None


def runs(it: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns: the key and the rows' other columns."""
    now, rows = None, []
    for b in batches(it):
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _maybe(marks: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share at least `least` of their samples, the most alike first: between the first `split` rows and
    the others, or among all where split is 0."""
    a, z = (marks[:split], marks[split:]) if split else (marks, marks)
    found = []
    for at in range(0, len(a), 64):
        share = np.zeros((min(64, len(a) - at), len(z)), np.uint16)
        for k in range(marks.shape[1]):
            share += a[at : at + 64, k, None] == z[None, :, k]
        x, y = np.nonzero(share >= least * marks.shape[1])
        found.append((x + at, y + split, share[x, y]))
    x, y, s = (np.concatenate(p) for p in zip(*found))
    if not split:
        x, y, s = x[x < y], y[x < y], s[x < y]
    order = np.argsort(-s.astype(np.int32), kind="stable")
    return x[order], y[order]


def families(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (u, v) that span the texts which meet in a bucket and share enough samples.  rows: doc_id, bands, mark."""
    k = BANDS * ROWS
    enough = least - SLACK * float(np.sqrt(least * (1 - least) / k))
    met = rows.select("doc_id", F.explode("bands").alias("key"))
    many = materialize(met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # marks join those that meet another, not every band of every text
    kept = met.join(many, "key").join(rows.select("doc_id", "mark"), "doc_id").select("key", "n", "doc_id", "mark")

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for key, own in runs((b.select(["key", "i", "j", "side", "doc_id", "mark"]) for b in it)):
            sides, ids, marks = zip(*own)
            got = _compared(key, list(sides), list(ids), np.frombuffer(b"".join(marks), np.uint8).reshape(len(own), k), enough, None)
            if got is not None:
                yield got

    return spanned(kept, "key", BUCKET_BLOCK, run, "met")


def similarity(a: tuple[np.ndarray, np.ndarray], z: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of least weights over the sum of largest."""
    if len(a[0]) > len(z[0]):
        a, z = z, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(z[0], a[0]), len(z[0]) - 1)
    same = z[0][at] == a[0]
    both = np.minimum(a[1][same], z[1][at[same]]).sum()
    return float(both / (a[1].sum() + z[1].sum() - both))


def verified(rows: DataFrame, idf: dict[int, float], least: float = LEAST) -> DataFrame:
    """Links (u, v) that span the texts of similarity `least` or more.  rows: family, n, doc_id, mark, text.

    A text goes to one task, a hub's to all of its family's; those of a rest, and of rows that
    meet them, once more for each block they meet.
    """
    k = BANDS * ROWS
    enough = least - SLACK * float(np.sqrt(least * (1 - least) / k))
    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        make = Shingler(idf)
        # a text becomes its shingles as it arrives, so that a block holds no texts
        for key, own in runs_of(it, make):
            sides, ids, marks, sets = zip(*own)
            got = _compared(key, list(sides), list(ids), np.frombuffer(b"".join(marks), np.uint8).reshape(len(own), k), enough, lambda x, y, sets=sets: similarity(sets[x], sets[y]) >= least)
            if got is not None:
                yield got

    def runs_of(it: Iterator[pa.RecordBatch], make: Shingler):
        now, own = None, []
        for b in batches(it, 64):
            for family, i, j, side, doc, mark, text in zip(*[b.column(c).to_pylist() for c in ("family", "i", "j", "side", "doc_id", "mark", "text")]):
                if (family, i, j) != now:
                    if own:
                        yield now, own
                    now, own = (family, i, j), []
                own.append((side, doc, mark, make.shingles(text)[:2]))
        if own:
            yield now, own

    return spanned(rows, "family", FAMILY_BLOCK, run, "verified")


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of every row of docs: doc_id, class_id (smallest id of its class), kept (doc_id = class_id).

    A class holds texts that links of similarity `least` or more lead to, copies included.  A text
    of one to four words is one shingle.  Texts without words (null: empty) are alike only if
    equal.  Rows that repeat an id are one document, linked to what any of them is linked to; a
    null id has a null class and is kept.  Of an empty table the result is empty.  Other
    columns are not looked at.
    """
    idf = word_weights(docs, text_col)
    marks = materialize(signed(docs, idf, id_col, text_col), "signed")
    copies = materialize(marks.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    named = materialize(marks.select("doc_id", "same").join(copies, "same", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "named")
    firsts = marks.join(copies.select("same", "rep"), "same", "left").filter("(rep is null or rep = doc_id) and mark <> X''").select("doc_id", "bands", "mark")
    firsts = materialize(firsts, "firsts")
    maybe = components(families(firsts, least))
    sizes = materialize(maybe.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    member = maybe.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "n")
    member = member.join(firsts.select("doc_id", "mark").dropDuplicates(["doc_id"]), "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    member = materialize(member, "members")
    texts = maybe_in(texts, "doc_id", member)
    links = verified(materialize(member.join(texts, "doc_id").select("family", "n", "doc_id", "mark", "text"), "texts"), idf, least)
    # an id that stands for several texts links them
    many = named.groupBy("doc_id").agg(F.min("rep").alias("u"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = components(links.unionByName(named.join(many, "doc_id").select("u", F.col("rep").alias("v"))))
    out = named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    out = out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    none = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)
