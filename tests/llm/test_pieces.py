import random

import numpy as np
import sentencepiece

from rasterlake.llm import pieces as P
from rasterlake.llm.queries import op10_pieces

from .conftest import SF


def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def test_query_gives_the_library_s_ids_and_the_texts_back(spark):
    lib = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = op10_pieces(spark, SF)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.ids == lib.encode(texts[r.doc_id]) and r.exact and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.text for r in P.decode_documents(out).collect()} == texts


def test_random_texts():
    random.seed(7)
    m, lib = P.Transducer(P.default_model()), library()
    some = list(" ▁\nabcdefghijklmnopqrstuvwxyzABCDE0123456789.,;:!?'\"-_()[]{}<>/=+*&^%$#@éèüßñçóî日本語の人中文字한글русский𝄞🙂\t\r\x00")
    texts = ["".join(random.choice(some[: random.choice([2, 3, 30, 60, len(some)])]) for _ in range(random.randint(0, 40))) for _ in range(10000)]
    texts += ["".join(random.choice(m.text) for _ in range(random.randint(1, 6))) for _ in range(10000)]
    texts += [" " * k + w for k in range(40) for w in ("", "a", "1", "the", " ", "日", "the  x ")]
    for t, x, y in zip(texts, m.encode(texts), lib.encode(texts)):
        assert x.tolist() == y, t
        assert m.decode(x) == t.replace("▁", " ")


def unigram(pieces: dict[str, float], rule: str = "identity", bytes_too: bool = False, squeeze: bool = False) -> bytes:
    """A model of the library's own format, put together by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = bytes_too
    if rule != "identity":
        m.normalizer_spec.ParseFromString(normaliser(rule))
    m.normalizer_spec.name = rule
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = True, True, squeeze
    kind = pb.ModelProto.SentencePiece
    rows = [("<unk>", 0.0, kind.UNKNOWN), ("<s>", 0.0, kind.CONTROL), ("</s>", 0.0, kind.CONTROL)]
    rows += [(f"<0x{b:02X}>", 0.0, kind.BYTE) for b in range(256)] if bytes_too else []
    for text, score, t in [*rows, *((k, v, kind.NORMAL) for k, v in pieces.items())]:
        m.pieces.add(piece=text, score=score, type=t)
    return m.SerializeToString()


def normaliser(rule: str) -> bytes:
    """The library's normaliser of that name, as its own format has it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return m.normalizer_spec.SerializeToString()


PIECES = {"▁": -1.5, "a": -2.01, "b": -2.5, "ab": -3.1003, "▁a": -3.02, "ba": -4.0071, "bab": -5.2, "c": -6.3, "▁cab": -7.11, "é": -4.5, "1": -3.3}


def test_shortest_path_against_all_paths_and_the_library():
    random.seed(1)
    for bytes_too in (False, True):
        data = unigram(PIECES, bytes_too=bytes_too)
        m, lib = P.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)

        def paths(w):
            if not w:
                yield 0.0
            for k in range(1, 5):
                if len(w) >= k and w[:k] in PIECES:
                    for c in paths(w[k:]):
                        yield c - PIECES[w[:k]]

        for _ in range(200):
            w = "".join(random.choice("abc") for _ in range(random.randint(0, 9)))
            got = m.shortest("▁" + w)
            assert abs(-sum(m.score[i] for i in got) - min(paths("▁" + w))) < 1e-5
        texts = ["".join(random.choice("abcé1 xyz日\n") for _ in range(random.randint(0, 20))) for _ in range(3000)]
        for t, x, y in zip(texts, m.encode(texts), lib.encode(texts)):
            assert x.tolist() == y, (bytes_too, t)


def test_normalisers_against_the_library():
    random.seed(2)
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        for squeeze in (False, True):
            data = unigram(PIECES, rule, squeeze=squeeze)
            m, lib = P.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
            texts = ["".join(random.choice(" aAbBÉé１ﬁ\u00a0\t\u0301e②㌔ｶﾞ\u3000xß") for _ in range(random.randint(0, 15))) for _ in range(3000)]
            for t, x, y in zip(texts, m.encode(texts), lib.encode(texts)):
                assert x.tolist() == y, (rule, squeeze, t)


def test_odd_and_empty_tables(spark, odd, none):
    lib = library()
    rows = P.encode_documents(odd).collect()
    want = sorted((str(r.doc_id), lib.encode(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want and all(r.exact for r in rows)
    assert P.encode_documents(none).count() == 0
    assert P.Transducer.of(P.default_model()).decode(np.array([], np.uint32)) == ""
