import random
from collections import defaultdict

import numpy as np
import pytest

from rasterlake.llm import neardup as N
from rasterlake.llm.components import components
from rasterlake.llm.queries import op1_neardup

from .conftest import SF


def classes(rows):
    """Least id that links or copies lead to, from every pair of texts that share a shingle."""
    n = defaultdict(int)
    for _, t in rows:
        for w in set(N.WORD.findall((t or "").lower())):
            n[w] += 1
    idf = {}
    for w, k in n.items():
        h = N.word_hash(w)
        idf[h - (1 << 64) if h >> 63 else h] = 1 + float(np.log(len(rows) / k))
    make = N.Shingler(idf)
    parts = [make.shingles(t or "") for _, t in rows]
    sets, by, same, ids = N.Sets(len(rows)), defaultdict(list), {}, {}
    for i, p in enumerate(parts):
        sets.join(same.setdefault(p[2], i), i)
        if rows[i][0] is not None:
            sets.join(ids.setdefault(rows[i][0], i), i)
        for s in p[0].tolist():
            by[s].append(i)
    for a, b in {(x, y) for v in by.values() for k, y in enumerate(v) for x in v[:k]}:
        if N.similarity(parts[a][:2], parts[b][:2]) >= N.LEAST:
            sets.join(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[sets.find(i)] = min(d, least.get(sets.find(i), d))
    return sorted((d, least[sets.find(i)]) for i, (d, _) in enumerate(rows))


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op1_neardup(spark, SF).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("hubs", [0, 1, 6])
def test_large_groups_in_many_blocks(spark, monkeypatch, hubs):
    monkeypatch.setattr(N, "HUBS", hubs)
    monkeypatch.setattr(N, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(N, "FAMILY_BLOCK", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(4):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(40):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes(docs)


def test_odd_and_empty_tables(spark, odd, none):
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id) for r in N.near_duplicates(odd).collect())
    # 2 and 3 are empty, 7 has white space only, which is another text; 6 repeats 1, 9 differs in case
    assert rows == [(-1, None), (1, 1), (2, 2), (3, 2), (5, 5), (6, 1), (6, 1), (7, 7), (8, 8), (9, 1)]
    assert N.near_duplicates(none).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    w = rng.uniform(1, 4, 3000)
    other = w * rng.choice([0.5, 1.0], 3000)
    a = (np.sort(s[:2500]), w[np.argsort(s[:2500])])
    b = (np.sort(s[500:]), other[500:][np.argsort(s[500:])])
    got = N.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 2500]), 4000)
    assert abs((got[0] == got[1]).mean() - N.similarity(a, b)) < 0.03


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(50)] + [(2000, 2000), (7000, 6999), (3, 3)]
    links += [(5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(150)]
    sets = N.Sets(8000)
    for a, b in links:
        sets.join(a, b)
    want = {x: sets.find(x) for p in links if p[0] != p[1] for x in p}
    rng.shuffle(links)
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_a_group_of_copies_costs_its_rows_and_not_their_square(spark):
    """A family of nearly equal texts goes to each task once; only what hangs on no hub meets all."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [" ".join([*text[:k % 190], f"x{k}", *text[k % 190 + 1 :]]) for k in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    marks = N.materialize(N.signed(docs, {}), "m")
    members = marks.select(N.F.lit(1).cast("long").alias("family"), N.F.lit(3000).cast("long").alias("n"), "doc_id", "mark")
    dealt = N.star(members, "family", N.FAMILY_BLOCK)
    assert dealt.count() < 3000 + 3 * N.HUBS * 6 and dealt.filter("side = 1").count() == 3000
    assert {r.class_id for r in N.near_duplicates(docs).collect()} == {0}


def test_weights_are_tf_idf(spark):
    docs = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "a x y"), (3, "a b")], "doc_id long, text string")
    idf = N.word_weights(docs)
    s, w, _ = N.Shingler(idf).shingles("a b c d e a b c d e")
    ln = {"a": 1.0, "b": 1 + np.log(3 / 2), "c": 1 + np.log(3), "d": 1 + np.log(3), "e": 1 + np.log(3)}
    assert sorted(w) == pytest.approx([sum(ln.values()) / 5] * 4 + [2 * sum(ln.values()) / 5])
