import re
from hashlib import sha256

from rasterlake.llm import secrets as S
from rasterlake.llm.queries import op7_secrets

from .conftest import SF


def brute(text):
    text = text or ""
    found = []
    for i, r in enumerate(S.RULES):
        for m in re.finditer(r.regex, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), i, m.end(), r.kind))
    return sorted(found)


def check(docs, got):
    texts = sorted((str(r.doc_id), *[sum(k == n for *_, k in brute(r.text)) for n in ("assign", "access", "hex")], ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(r.text))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.spans) for r in got.collect()) == texts
    for r in got.collect():
        base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert r.base_sha256 == sha256(base.encode()).hexdigest()


def test_query_finds_what_a_plain_search_finds(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), op7_secrets(spark, SF))


def test_odd_and_empty_tables(spark, odd, none):
    check(odd, S.digest(S.scan(odd)))
    assert S.scan(none).count() == 0 and S.redact(none).count() == 0


def test_hard_texts(spark):
    texts = ["token=secret:abcdefgh", "password:=abcdefg", "token=token=token=abcdefgh", "AKIAAKIA" + "B" * 9, "a" * 31, "a" * 32 + "g" + "0" * 33, "API_KEY = 'abcdefgh'x", "𝄞é secret : 12345678 𝄞 ghp_" + "a" * 40, "\x01\x02token:12345678\x01", "xoxb-1234567890 -----BEGIN RSA PRIVATE KEY----- AIza" + "x" * 35, "eyJ" + ".".join(["a" * 12] * 3)] + ["secret=abcdefgh " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, S.digest(S.scan(docs)))
    clean = {r.doc_id: r.text for r in S.redact(docs).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for a, _, b, _ in brute(t):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + t[at:]


def test_very_long_texts_and_many_matches(spark):
    texts = ["".join(f"x{i} secret=abcd{i:05d} " + "word " * (i % 7) + "é" * (i % 3) for i in range(5000)), "f" * 40 + " plain " * 100_000 + "e" * 40, " ".join(["0123456789abcdef" * 2] * 3000)]
    docs = spark.createDataFrame([*enumerate(texts), (1, "again"), (1, texts[1])], "doc_id long, text string")
    check(docs, S.digest(S.scan(docs)))
    clean = [r.text for r in S.redact(docs).orderBy("doc_id").collect()]
    assert len(clean) == 5 and clean[0] == re.sub(r"secret=abcd\d{5}", "[SECRET]", texts[0]) and clean[4] == " ".join(["[SECRET]"] * 3000)


def test_probes():
    assert S.probe(S.BASE[2]) == "[0-9a-f]{32,}" and S.probe(S.BASE[1]) == S.BASE[1].regex
    assert S.probe(S.Rule("x", "[a-c]+|d", 9)) == "[a-c]+|d"


def test_trigram_queries():
    assert S.trigram_query("[0-9a-f]+") is None
    assert S.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    clauses = S.trigram_query(S.BASE[0].regex)
    assert frozenset({"tok", "oke", "ken"}) in clauses and len(clauses) == 6
    assert S.trigram_query("ab+c|xyz") is None and S.trigram_query("(abc|xyz)d?.foo") is not None
    for t, r in (("x_key" * 3, "x_?key"), ("foobarbaz", "foo(bar|qux)b.z")):
        assert any(c <= {t[i : i + 3] for i in range(len(t) - 2)} for c in S.trigram_query(r))
