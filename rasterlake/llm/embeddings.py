"""Near-duplicate embeddings: product quantisation over inverted lists, reranked by exact cosine.

Vectors are scaled to length one.  Coarse centroids and, for the residuals, a codebook for each
subspace are fitted on a bounded sample; every vector is then put in the list of its nearest
centroid with its codes.  Two vectors of cosine c are sqrt(2 - 2c) apart, and a neighbour that
lies in another list is beyond the plane between the two centroids.  So a vector that is farther
from that plane than this distance has no neighbour in the list, and it probes all other lists:
none is lost, and as that holds for either vector of a pair, one of them need probe.  Lists near
each other form groups, of which each has one copy of a vector that probes any of its lists; all
pairs in a group meet.  Vectors that are farther from what a code stands for than the distance
plus the code's own error are left out (that loses nothing), and the rest are compared exactly
in double precision.  Vectors without structure probe nearly all groups: then the work grows with
the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .components import components

SUBSPACES, CODES = 8, 256
SAMPLE, SAMPLE_PER_LIST = 1 << 18, 64  # vectors that a quantiser is fitted on, at most
FLAT = 4096  # lists that are fitted at once; more are fitted within a first set of cells
BLOCK = 1024  # vectors compared with as many at a time
SIDE = 4  # such blocks that are dealt together, and are a group on average


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(p @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for p in np.array_split(x, max(1, len(x) * k >> 24))])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids or nearly: of all vectors, or where k is large of the vectors of each of sqrt(k) cells."""
    if k <= FLAT:
        return _kmeans(x, k, 8, rng)
    cells = _kmeans(x, int(np.sqrt(k)), 8, rng)
    near = np.concatenate([(p @ cells.T - 0.5 * (cells * cells).sum(1)).argmax(1) for p in np.array_split(x, max(1, len(x) * len(cells) >> 24))])
    own = [x[near == c] for c in range(len(cells))]
    return np.concatenate([_kmeans(p, max(1, min(len(p), round(k * len(p) / len(x)))), 8, rng) for p in own if len(p)])


class Quantiser:
    """Coarse centroids, in order of their groups, and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, groups: int = 1, seed: int = 6):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        centre = _centres(sample, max(1, min(lists, len(sample))), rng)
        middle = _kmeans(centre, max(1, min(groups, len(centre))), 4, rng)
        group = np.unique((centre @ middle.T - 0.5 * (middle * middle).sum(1)).argmax(1), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        self.centre, self.group = centre[order], group[order]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        rest = sample - self.centre[self.home(sample)[0]]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:z]), min(CODES, len(rest)), 6, rng) for a, z in zip(self.cuts, self.cuts[1:])]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and its squared distances to all."""
        d = np.maximum((x * x).sum(1)[:, None] + (self.centre**2).sum(1) - 2 * x @ self.centre.T, 0)
        return d.argmin(1), d

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """Groups after a vector's own that have a list where a neighbour within `reach` may lie; its own is first."""
        home, d = self.home(x)
        gaps = self.home(self.centre[home])[1]  # squared, from a vector's own centroid to all
        # (d - own) / (2 * gap) is how far off the plane is; the small numbers are more than any rounding
        ok = d - d[np.arange(len(home)), home][:, None] <= 2 * (reach + 1e-6) * np.sqrt(gaps + 1e-12) + 1e-9
        ok = np.logical_or.reduceat(ok, np.flatnonzero(np.diff(self.group, prepend=-1)), axis=1)
        return [np.concatenate([[g], np.flatnonzero(row[g + 1 :]) + g + 1]) for g, row in zip(self.group[home], ok)]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes stand for."""
        rest, codes, back = x - self.centre[home], [], []
        for (a, z), book in zip(zip(self.cuts, self.cuts[1:]), self.books):
            code = (rest[:, a:z] @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            codes.append(code.astype(np.uint8))
            back.append(book[code])
        return np.stack(codes, 1), np.sqrt(((rest - np.concatenate(back, 1)) ** 2).sum(1))

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes of these lists stand for."""
        return self.centre[home] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)


def _spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label that links lead to, for the rows and the columns of a block: rows are 0..a-1, columns a.."""
    a, z = links.shape
    rows, cols = np.arange(a), np.arange(a, a + z)
    none = a + z
    while True:
        new_cols = np.minimum(cols, np.where(links, rows[:, None], none).min(0, initial=none))
        new_rows = np.minimum(rows, np.where(links, new_cols[None, :], none).min(1, initial=none))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _pack(x: np.ndarray) -> bytes:
    """Doubles, in single precision where that is the same."""
    short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _unpack(rows: list[bytes], d: int) -> np.ndarray:
    if all(len(r) == 4 * d for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, d).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * d else np.float64).astype(np.float64) for r in rows])


def _floats(column: pa.Array) -> list[np.ndarray]:
    """Each row of a list column as doubles."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:z].astype(np.float64) for a, z in zip(ends, ends[1:])]


def link(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """Links of all vectors of cosine `least` or more: vec_id, n_links, component_id, kept.

    n_links: other rows linked directly; component_id: smallest id that links lead to; kept:
    vec_id = component_id.  Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing; neither do vectors of different lengths, nor rows without an
    id.  Equal vectors are one entry of the index with a count.  Rows that repeat an id count
    each.  Of an empty table the result is empty.  Other columns are not looked at.

    All links are found.  Vectors of each length have a quantiser of their own, fitted on at most
    SAMPLE of them (those of a length that has no more than BLOCK are compared as they are, in
    one block); lists grow with the square root of the entries, up to a quarter of SAMPLE.
    """
    reach = float(np.sqrt(2 - 2 * least))
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)) & F.col(id_col).isNotNull(), v.cast("array<double>")).alias("vec")).withColumn("same", F.when(F.col("vec").isNotNull(), F.sha2(F.to_json(F.struct("vec")).cast("binary"), 256))), "vectors")
    entries = rows.filter("vec is not null").groupBy("same").agg(F.min("vec_id").alias("doc_id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    entries = materialize(entries, "entries")
    lengths = [(r.d, r.n) for r in entries.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).orderBy("d").collect()]
    models, first = {}, {}  # by length: the quantiser, and the number of its first group
    for d, total in lengths:
        own_lists = min(SAMPLE // 4, lists or max(1, int(np.sqrt(total))))
        some = entries.filter(F.size("vec") == d).orderBy(F.xxhash64("doc_id")).limit(min(SAMPLE, own_lists * SAMPLE_PER_LIST)).select("vec").toArrow()
        x = np.stack(_floats(some.column("vec").combine_chunks()))
        first[d] = sum(m.group.max() + 1 for m in models.values())
        models[d] = Quantiser(x / np.linalg.norm(x, axis=1)[:, None], own_lists, -(-total // (SIDE * BLOCK)))
    starts, by_start = np.array(list(first.values())), list(first)

    def length_of(group: int) -> int:
        return by_start[int(np.searchsorted(starts, group, side="right")) - 1] if group >= 0 else -group

    def index(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                vecs = _floats(p.column("vec"))
                out: list[tuple] = []
                probes, codes, errors = {}, {}, {}
                for d in {len(x) for x in vecs} & models.keys():
                    fit, model = [i for i, x in enumerate(vecs) if len(x) == d], models[d]
                    x = np.stack([vecs[i] for i in fit])
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    home = model.home(x)[0]
                    c, e = model.encode(x, home)
                    for i, pr, hi, ci, ei in zip(fit, model.probes(x, reach), home.astype(np.int32), c, e):
                        probes[i], codes[i], errors[i] = pr + first[d], hi.tobytes() + ci.tobytes(), float(ei)
                for i, (doc, n) in enumerate(zip(p.column("doc_id").to_pylist(), p.column("n").to_pylist())):
                    raw = _pack(vecs[i])
                    if i in probes:
                        out.append((int(probes[i][0]), 0, doc, n, raw, codes[i], errors[i]))
                        out += [(int(k), 1, doc, n, raw, b"", 0.0) for k in probes[i][1:]]
                    else:
                        out.append((-len(vecs[i]), 0, doc, n, raw, b"", 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), (pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()))], names=["list", "query", "doc_id", "n", "raw", "code", "error"])

    shape = "list int, query byte, doc_id long, n long, raw binary, code binary, error double"
    listed = entries.select("doc_id", "n", "vec").mapInArrow(tidy(index), shape)
    listed = materialize(listed, "lists")
    # members meet members of their own group by pairs of blocks; those who probe the group meet each block of members
    sizes = materialize(listed.groupBy("list").agg(F.count(F.when(F.col("query") == 0, 1)).alias("n")), "sizes")
    own = _spread(listed, sizes)

    def meet(ids: list[np.ndarray], n: list[np.ndarray], a: np.ndarray, z: np.ndarray, may: np.ndarray, same: bool) -> tuple | None:
        """Links among the pairs that may be: ids, the least id that each is linked to, number of rows linked."""
        if same:
            np.fill_diagonal(may, False)
        r, c = np.nonzero(may)
        yes = np.concatenate([np.zeros(0, bool)] + [(a[rr] * z[cc]).sum(1) / (np.sqrt((a[rr] ** 2).sum(1)) * np.sqrt((z[cc] ** 2).sum(1))) >= least for rr, cc in ((r[at : at + (1 << 16)], c[at : at + (1 << 16)]) for at in range(0, len(r), 1 << 16))])
        r, c = r[yes], c[yes]
        if not len(r):
            return None
        if same:
            r, c = np.concatenate([r, c]), np.concatenate([c, r])
        (left, r), (right, c) = (np.unique(x, return_inverse=True) for x in (r, c))
        hit = np.zeros((len(left), len(right)), bool)
        hit[r, c] = True
        rows_to, cols_to = _spanning(hit | np.eye(len(left), dtype=bool) if same else hit)
        names = np.concatenate([ids[0][left], ids[1][right]])
        if same:
            return names[: len(left)], names[rows_to], hit @ n[1][right]
        return names, names[np.concatenate([rows_to, cols_to])], np.concatenate([hit @ n[1][right], hit.T @ n[0][left]])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for (of, *_), left, right in _blocks(it):
            same = right is None
            q, y = left, left if same else right
            if not len(q[0]) or not len(y[0]):
                continue
            a, z = (_unpack(s[2], length_of(of)) for s in (q, y))
            ids, n = ([np.array(s[k], np.int64) for s in (q, y)] for k in (0, 1))
            if of >= 0:
                unit = a / np.sqrt((a * a).sum(1))[:, None]
                codes = np.frombuffer(b"".join(y[3]), np.uint8).reshape(len(z), -1)
                stands = models[length_of(of)].decode(np.ascontiguousarray(codes[:, :4]).view(np.int32)[:, 0], codes[:, 4:])
                # |u - s| <= reach + error, for a vector u of length one
                least_dot = (1 + (stands * stands).sum(1) - (reach + np.array(y[4]) + 1e-6) ** 2) / 2 - 1e-9
            for at in range(0, len(a), BLOCK):
                for to in range(at if same else 0, len(z), BLOCK):
                    i, j = slice(at, at + BLOCK), slice(to, to + BLOCK)
                    may = unit[i] @ stands[j].T >= least_dot[j] if of >= 0 else np.ones((len(a[i]), len(z[j])), bool)
                    got = meet([ids[0][i], ids[1][j]], [n[0][i], n[1][j]], a[i], z[j], may, same and at == to)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["u", "v", "n"])

    found = materialize(own.mapInArrow(tidy(compare), "u long, v long, n long"), "found")
    comp = components(found.select("u", "v")).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    counts = found.groupBy(F.col("u").alias("doc_id")).agg(F.sum("n").alias("more"))
    entry = entries.select("same", "doc_id", "n").join(counts, "doc_id", "left").join(comp, "doc_id", "left")
    entry = materialize(entry.select("same", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")), "entry")
    out = rows.filter("vec is not null").select("vec_id", "same").join(entry, "same").select("vec_id", "n_links", "component_id")
    rest = rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _spread(listed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of each pair of blocks together.

    Members: pairs of blocks i <= j of their list (guest -1).  Guests, who probe the list: block
    `guest` of guests with block i of members.
    """
    many = materialize(listed.filter("query = 1").groupBy("list").agg(F.count("*").alias("guests")), "guests")
    sizes = sizes.join(many, "list", "left").select("list", F.greatest(F.lit(1), F.ceil(F.col("n") / (SIDE * BLOCK))).cast("int").alias("own"), F.ceil(F.coalesce("guests", F.lit(0)) / (SIDE * BLOCK)).cast("int").alias("away"))
    rows = listed.join(materialize(sizes, "blocks"), "list")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("query") == 0, F.col("own")).otherwise(F.col("away"))).cast("int")
    rows = rows.withColumn("part", part)
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = rows.filter("query = 0")
    cell = lambda i, j, side, guest: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), guest.cast("int").alias("guest"))
    none = F.array().cast("array<struct<i:int,j:int,side:int,guest:int>>")
    pairs = F.transform(span("own"), lambda o: cell(F.least(F.col("part"), o), F.greatest(F.col("part"), o), (F.col("part") > o), F.lit(-1)))
    hosts = F.when(F.col("away") > 0, F.transform(span("away"), lambda g: cell(F.col("part"), F.lit(0), F.lit(1), g))).otherwise(none)
    visits = F.transform(span("own"), lambda o: cell(o, F.lit(0), F.lit(0), F.col("part")))
    at = members.withColumn("at", F.explode(F.concat(pairs, hosts))).unionByName(rows.filter("query = 1").withColumn("at", F.explode(visits)))
    flat = at.select("list", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.guest").alias("guest"), F.col("at.side").alias("side"), "doc_id", "n", "raw", "code", "error")
    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(n, "list", "i", "j", "guest").sortWithinPartitions("list", "i", "j", "guest", "side")


def _blocks(it: Iterator[pa.RecordBatch]):
    """(list, i, j, guest), rows of the first side, rows of the second (None: a block with itself), as columns."""
    now, sides = None, None

    def done():
        same = now[3] < 0 and now[1] == now[2]
        return now, sides[0], None if same else sides[1]

    for b in it:
        for *key, side, doc, n, raw, code, error in zip(*[c.to_pylist() for c in b.columns]):
            if tuple(key) != now:
                if now is not None:
                    yield done()
                now, sides = tuple(key), tuple(([], [], [], [], []) for _ in range(2))
            for col, x in zip(sides[side], (doc, n, raw, code, error)):
                col.append(x)
    if now is not None:
        yield done()
