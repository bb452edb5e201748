import hashlib
import re
import unicodedata

import xxhash

from rasterlake.llm import fingerprints as P
from rasterlake.llm.queries import op3_fingerprints

from .conftest import SF


def canon(text):
    """The canonical text, spelled out here so that the module's own cannot vouch for itself."""
    folded = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))
    return folded.strip().encode("utf-8", "surrogatepass")


def want(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0], r[1].encode("utf-8", "surrogatepass")))
    out = []
    for k, (d, t) in enumerate(rows):
        after, nxt = rows[(k + 1) % len(rows)]
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        name = lambda x: xxhash.xxh3_128(canon(x)).hexdigest()
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), name(t), name(e), float(canon(t) == canon(e)), float(canon(t) == canon(nxt)), after))
    return out


def test_query_against_a_plain_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op3_fingerprints(spark, SF).collect()) == want(docs)


def test_odd_and_empty_tables(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in P.fingerprint(odd).collect()), key=str) == sorted(want(docs), key=str)
    assert P.fingerprint(none).count() == 0
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    assert P.fingerprint(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_canonical_texts():
    assert P.canonical("  Ａbc\t\n STRASSE ﬁ ") == P.canonical("abc straße fi") == b"abc strasse fi"
    assert P.canonical("a b") != P.canonical("ab")


def test_equal_digests_of_unlike_texts_are_told_apart(spark):
    short = lambda found: P.digest(found)[:1] * 32
    texts = [f"text {i} and {i}" for i in range(60)] * 2
    docs = spark.createDataFrame([*enumerate(texts), (119, "another text of an id that repeats")], "doc_id long, text string")
    rows = P.fingerprint(docs, make=short).collect()
    assert len(rows) == 121
    plain = {(d, sha): (a, b) for d, _, sha, a, b, *_ in want([*enumerate(texts), (119, "another text of an id that repeats")])}
    pairs = {(x, y) for r in rows for x, y in zip((r.fingerprint, r.edited_fingerprint), plain[r.doc_id, r.edited_sha256])}
    # one to one: a fingerprint for each canonical text, edited or not
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) > 100
