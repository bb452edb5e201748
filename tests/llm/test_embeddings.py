import numpy as np
import pytest

from rasterlake.llm import embeddings as E
from rasterlake.llm.queries import op6_embeddings

from .conftest import SF


def brute(ids, vecs, least=0.9):
    ok = [i for i, v in enumerate(vecs) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and ids[i] is not None]
    n, up = dict.fromkeys(range(len(ids)), 0), list(range(len(ids)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in ok:
        for b in ok:
            if a < b and len(vecs[a]) == len(vecs[b]):
                x, y = np.array(vecs[a], float), np.array(vecs[b], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    up[find(a)] = find(b)
    least_id = {}
    for i in ok:
        least_id[find(i)] = min(ids[i], least_id.get(find(i), ids[i]))
    return [(ids[i], n[i], least_id.get(find(i), ids[i])) for i in range(len(ids))]


def key(rows):
    return sorted(rows, key=str)


def test_query_finds_the_links_of_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = [(r.vec_id, r.n_links, r.component_id) for r in op6_embeddings(spark, SF).collect()]
    assert key(got) == key(brute([r.vec_id for r in rows], [r.embedding for r in rows]))


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_on_close_and_far_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 32))
    near = base[rng.integers(0, 150, 250)]
    near = near / np.linalg.norm(near, axis=1)[:, None] + rng.normal(size=near.shape) / np.sqrt(32) * rng.uniform(0, 0.5, (250, 1))
    vecs = np.concatenate([base, near, np.tile(base[:1], (60, 1))]).astype("f4").astype(float).tolist()
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    want = brute(range(len(vecs)), vecs)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(df).collect()}
    assert sum(x for x, _ in got.values()) >= 0.97 * sum(n for _, n, _ in want)
    assert all(got[i][0] <= n for i, n, _ in want)
    assert sum(got[i][1] == c for i, _, c in want) >= 0.97 * len(want)


def test_all_links_of_vectors_of_few_dimensions(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 64)) + 0.3 * rng.normal(size=(3000, 64))
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    least = np.arange(3000)
    while (less := np.minimum(least, np.where(links, least, 3000).min(1))).tolist() != least.tolist():
        least = less
    got = E.link(spark.createDataFrame(list(enumerate(vecs.tolist())), "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) == links.sum()
    assert all(r.n_links == links[r.vec_id].sum() and r.component_id == least[r.vec_id] for r in got)


def test_odd_and_empty_tables(spark):
    vecs = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [-1.0, -2.0], [3.0, 1.0], [1.0, 2.0]]
    ids = [*range(13), None]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in zip(ids, vecs)], "vec_id long, embedding array<double>, list string, n int, u int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in E.link(df).collect()]
    assert key(got) == key(brute(ids, vecs))
    assert E.link(df.limit(0)).count() == 0


def test_recall_over_thousands_of_two_lengths(spark, monkeypatch):
    """Planted neighbours at cosines around the limit, against all pairs."""
    monkeypatch.setattr(E, "BLOCK", 256)
    monkeypatch.setattr(E, "FLAT", 16)
    rng = np.random.default_rng(9)
    vecs = []
    for d, n in ((64, 5000), (48, 1500)):
        base = rng.normal(size=(n // 2, d))
        base /= np.linalg.norm(base, axis=1)[:, None]
        away = rng.normal(size=base.shape)
        away -= (away * base).sum(1)[:, None] * base
        away /= np.linalg.norm(away, axis=1)[:, None]
        cos = rng.uniform(0.86, 0.99, len(base))[:, None]
        vecs += [*base, *(cos * base + np.sqrt(1 - cos**2) * away)]
    got = {r.vec_id: r for r in E.link(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>")).collect()}
    links = 0
    for a, z in ((0, 5000), (5000, 6500)):
        x = np.array(vecs[a:z])
        x /= np.linalg.norm(x, axis=1)[:, None]
        hit = x @ x.T >= 0.9
        np.fill_diagonal(hit, False)
        assert [got[a + k].n_links for k in range(z - a)] == hit.sum(1).tolist()  # recall 1, and none too many
        links += hit.sum()
    assert links > 3000
