import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import toxicity as X
from rasterlake.llm.queries import op2_toxicity

from .conftest import SF


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    s = np.asarray(scores)[order]
    for v in np.unique(s):
        own = order[s == v]
        ranks[own] = np.flatnonzero(s == v).mean() + 1
    y = np.asarray(labels, bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_labels(spark):
    rows = op2_toxicity(spark, "/root/testdata/sf0.1").select("doc_id", "held_out", "score", "predicted").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert auc([r.score for r in own], [toxic[r.doc_id] for r in own]) > 0.95
    clean = [r.predicted for r in own if not toxic[r.doc_id]]
    assert sum(clean) <= 0.02 * len(clean)
    bad = [r.predicted for r in own if toxic[r.doc_id]]
    assert sum(bad) >= 0.7 * len(bad)  # 300 toxic examples here; with 1,500 it is 0.99
    # calibrated: among those of high score, about as many are toxic as the scores say
    high = [r for r in own if r.score >= 0.5]
    assert abs(np.mean([r.score for r in high]) - np.mean([toxic[r.doc_id] for r in high])) < 0.12


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_block_max_search_is_exact(monkeypatch, share):
    monkeypatch.setattr(X, "LONG", share)
    rng = np.random.default_rng(1)
    terms = np.arange(60)
    n = 700
    vecs = []
    for _ in range(n):
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        vecs.append((t, rng.integers(1, 4, len(t))))
    m = X.Model(terms, rng.uniform(0.5, 5, 60), np.arange(n), rng.integers(0, 2, n).astype(float), np.ones(n), 0.5, 0.5, vecs)
    assert all((a == x).all() and (c == y).all() for (a, c), (x, y) in zip(m.vectors(), vecs))
    dense = np.zeros((n, 60))
    for i, (t, c) in enumerate(vecs):
        dense[i, t] = m.weights(t, c)
    own = list(range(0, n, 7))
    for many in (0, n):  # by single precision first, or by bounds alone
        monkeypatch.setattr(X, "MANY", many)
        for i, (best, cos) in zip(own, m.nearest([vecs[i] for i in own], but=own)):
            all_cos = np.round(dense @ dense[i], 12)
            all_cos[i] = 0
            order = np.lexsort((np.arange(n), -all_cos))[: X.NEIGHBOURS]
            order = order[all_cos[order] > 0]
            assert cos == pytest.approx(all_cos[order]) and (len(cos) == X.NEIGHBOURS or (all_cos > 0).sum() == len(cos))


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in X.score(docs, y).collect()} for y in (labels, other))
    assert a == b


def test_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (6, 1), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0), labels.filter("toxic = 1")):
        rows = X.score(odd, y).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        same = {r.score for r in rows if r.doc_id in (1, 6)}
        assert len(same) == 1
    assert X.score(none, labels).count() == 0


def test_scores_against_brute_force(spark):
    """Evidence and votes of the query, worked out from dense TF-IDF vectors of the whole texts; scores follow the votes."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    counts = {d: Counter(re.findall(r"\w+", t.lower())) for d, t in docs.items()}
    ids = sorted(labels)
    words = sorted({w for d in ids for w in counts[d]})
    y = np.array([labels[d] for d in ids])
    has = np.array([[w in counts[d] for w in words] for d in ids])
    df = np.array([sum(w in c for c in counts.values()) for w in words])
    n, a, b = len(ids), has[y == 1].sum(0), has[y == 0].sum(0)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    chi = n * (a * (n0 - b) - b * (n1 - a)).astype(float) ** 2 / np.maximum(1, (a + b) * (n - a - b) * n0 * n1)
    weigh = np.log(1 + len(docs) / df) * np.sqrt(1 + chi)

    def vector(d):
        tf = np.array([counts[d][w] for w in words], float)
        v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * weigh
        return v / (np.linalg.norm(v) or 1)

    own = np.array([vector(d) for d in ids])
    prior, votes = n1 / n, {}
    rows = {r.doc_id: r for r in op2_toxicity(spark, SF).collect()}
    assert sorted(rows) == sorted(docs)
    for d, r in rows.items():
        cos = own @ vector(d)
        order = [i for i in np.lexsort((ids, -np.round(cos, 12)))[: X.NEIGHBOURS] if cos[i] > 1e-12]
        assert [(e.cosine, e.toxic) for e in r.evidence] == [(pytest.approx(cos[i], abs=1e-9), y[i]) for i in order[:3]]
        votes[d] = (cos[order] @ y[order] + X.PRIOR * prior) / (cos[order].sum() + X.PRIOR) if order else None
    ranked = sorted((v, rows[d].score) for d, v in votes.items() if v is not None)
    assert all(s <= t + 1e-9 for (v, s), (w, t) in zip(ranked, ranked[1:]) if w > v + 1e-9)


def test_examples_are_bounded_where_ids_repeat(spark):
    one, two = [d for d in range(100) if zlib.crc32(str(d).encode()) % 3 != 1][:2]
    docs = spark.range(30).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(two, "good day")], "doc_id long, text string"))
    labels = spark.createDataFrame([(one, 1), (one, 0), (two, 0)], "doc_id long, toxic int")
    model, table, _ = X.fit(docs, labels)
    assert sorted(model.ids) == [one, two] and table.count() == 31
