from collections import Counter

import corpus_pipeline as C
import sentencepiece
from pyspark.sql import functions as F

from rasterlake.llm import pieces as P
from rasterlake.llm import secrets as S
from rasterlake.llm import toxicity as X

from .conftest import SF
from .test_neardup import classes
from .test_secrets import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r.doc_id: r.score for r in X.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] < C.TOXIC}
    texts = {d: texts[d] for d, c in classes(sorted(texts.items())) if d == c}
    clean = {}
    for d, t in texts.items():
        out, at = [], 0
        for a, _, b, _ in brute(t):
            if a >= at:
                out += [(t or "")[at:a], "[SECRET]"]
            at = max(at, b)
        clean[d] = "".join(out) + t[at:] if out else t
    step = docs
    for name, stage in C.STAGES[:3]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
    step = step.cache()
    assert {r.doc_id: r.text for r in step.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in step.collect() if "[SECRET]" in r.text)
    mixed = C.mix_sources(spark, step, SF)
    assert mixed.columns == docs.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.copies for r in C.mixing.mix(step).collect() if r.copies}
    assert taken == want
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    rows = C.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == taken
    assert all(r.ids == lib.encode(clean[r.doc_id]) for r in rows)


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd, none):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert (out.count() == 0) == (docs.count() == 0)
    assert S.redact(odd).filter(F.col("text").contains("[SECRET]")).count() == 1
