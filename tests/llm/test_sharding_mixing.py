import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterlake.llm.mixing import mix, mixed, targets
from rasterlake.llm.queries import op5_sharding, op9_mixing
from rasterlake.llm.sharding import assign_shards

from .conftest import SF


def test_shards_of_the_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_growth(spark):
    ids = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = assign_shards(ids, (1.0, 2.0, 5.0), 2.0).groupBy("shard", "grown_shard").count().collect()
    n = Counter()
    for r in rows:
        n[r.shard] += r["count"]
        assert r.grown_shard in (r.shard, 3)
    assert [round(n[i] / 40000, 2) for i in range(3)] == pytest.approx([0.125, 0.25, 0.625], abs=0.02)
    assert sum(r["count"] for r in rows if r.grown_shard == 3) / 40000 == pytest.approx(0.2, abs=0.02)
    with pytest.raises(ValueError):
        assign_shards(ids, (1.0, 0.0))


def test_odd_tables(spark, odd, none):
    rows = assign_shards(odd, (1.0,)).collect()
    assert sorted(r.slot for r in rows) == list(range(10)) and {r.shard for r in rows} == {0}
    assert assign_shards(none).count() == 0 and mix(none).count() == 0
    rows = mix(odd).collect()
    assert len(rows) == 10 and sum(r.taken for r in rows if r["size"] == 0) == 0
    got = mixed(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: n for d in {r.doc_id for r in rows} if (n := sum(r.copies for r in rows if r.doc_id == d))})


def test_rows_that_repeat_an_id_or_have_none_do_not_multiply(spark):
    rows = [(1, "a b c", "x"), (1, "d e f", "x"), (None, "g h i", "x"), (None, "j k l", "x"), (2, "m n o", "x"), (3, "p q r", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_mixrow": F.lit(7), "_mixn": F.lit(7)})
    want = sum(r.copies for r in mix(docs).collect())
    got = mixed(docs).collect()
    assert len(got) == want and 8 <= want <= 10 and {r._mixrow for r in got} == {7}


def test_long_documents_have_the_better_chance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 10).otherwise(1000).cast("int")).alias("text"), F.lit("x").alias("source"))
    own = mix(docs, share=0.5, cap=1.0).groupBy("size").agg(F.sum("copies").alias("n")).collect()
    taken = {r["size"]: r.n / 2000 for r in own}
    odds = {k: p / (1 - p) for k, p in taken.items()}
    assert odds[1000] / odds[10] == pytest.approx((1001 / 11) ** 0.5, rel=0.25)
    equal = {r["size"]: r.n / 2000 for r in mix(docs, share=0.5, cap=1.0, odds=lambda size: F.lit(1.0)).groupBy("size").agg(F.sum("copies").alias("n")).collect()}
    assert equal[10] == pytest.approx(equal[1000], abs=0.05)


def test_mix_meets_its_targets(spark):
    rows = op9_mixing(spark, SF).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, op9_mixing(spark, SF).collect()))
    by = defaultdict(list)
    for r in rows:
        by[(r.source_size, r.target)].append(r)
    for (size, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
        assert target <= 2 * size and all(r.taken <= 2 * r["size"] for r in own)
        assert len({r.taken // r["size"] for r in own if r["size"]}) <= 2
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))


def test_targets_are_what_resharing_step_by_step_gives(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 7, None: 50, "é": 400}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values())
    open_ = set(sizes)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            want[s] += share * w[s]
        for s in list(open_):
            if want[s] >= 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                open_.discard(s)
    assert got == pytest.approx(want)
