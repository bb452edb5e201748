import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rasterlake.llm import tokens as T
from rasterlake.llm.queries import op8_tokens

from .conftest import SF


def want(rows):
    tok = Tokenizer.from_file(T.default_tokenizer())
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_returns_the_library_s_ids(spark):
    got = [tuple(r) for r in op8_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == want(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_odd_and_empty_tables(spark, odd, none):
    got = [tuple(r) for r in T.tokenize(odd).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want(odd.collect())
    assert T.tokenize(none).count() == 0


def test_files_round_trip():
    rng = np.random.default_rng(3)
    flat = np.minimum(rng.zipf(1.3, 600_000), 49_000).astype(np.uint32)
    t = T.Table(np.bincount(flat, minlength=49_408))
    assert int(t.freq.sum()) == 1 << T.BITS and (t.freq[np.unique(flat)] > 0).all()
    for n in (0, 1, 2, 63, 64, 65, 4097, 600_000):
        cuts = np.sort(rng.integers(0, n + 1, 5))
        parts = np.split(flat[:n], cuts)
        ids, sizes, back, part, before = T.decode_file(T.encode_file([5, None, 7, 8, 9, 10], parts, t, 3, 1 << 40), t)
        assert (part, before) == (3, 1 << 40)
        assert ids == [5, None, 7, 8, 9, 10] and sizes.tolist() == [len(p) for p in parts] and (back == flat[:n]).all()
    one = T.Table(np.array([0, 9]))
    assert (T.decode_file(T.encode_file([1], [np.ones(999, np.uint32)], one), one)[2] == 1).all()


def test_checkpoints_and_checksums():
    flat = np.random.default_rng(4).integers(0, 3000, T.BLOCK).astype(np.uint32)
    t = T.Table(np.bincount(flat))
    data = T._encode_block(flat, t)
    for k in (1, 3, T.BLOCK // T.LANES // T.EVERY - 1):
        assert (T.decode_block(data, t, from_step=k * T.EVERY)[0] == flat[k * T.EVERY * T.LANES :]).all()
    for at in (40, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises((ValueError, IndexError)):
            T.decode_block(bytes(bad), t)
    with pytest.raises(ValueError):
        T.decode_file(T.encode_file([1], [flat], t), T.Table(np.bincount(flat, minlength=5000) + 1))


def test_pieces_are_encoded_as_in_their_text():
    rng = np.random.default_rng(5)
    parts = [" ", "\n", "\t", "a", "bc", "ABC", "0", "19", ".", "'s", "'LL", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "é", "Σ", "σ", "İ", "Å", "日本", "𝄞", "🙂", "<|", "Ñandú", "ǅ", "ß", "ÿ", "²", "½", "_", "--", "…", "e\u0301", "ﬁ", "don't"]
    texts = [chr(c) + "a" + chr(c) for c in range(1, 0x3000)]
    texts += ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(5000)]
    w = T.Encoder(T.default_tokenizer())
    assert w.known
    for x, y in zip(w.encode(texts), w.tok.encode_batch(texts, add_special_tokens=False)):
        assert x.tolist() == y.ids


def test_files_are_real_and_read_back(spark, odd, tmp_path):
    table, manifest = T.write(odd, f"file://{tmp_path}/a")
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert names == sorted(r.path for r in manifest.collect()) and all((tmp_path / "a" / n).read_bytes()[:8] == T.MAGIC for n in names)
    got = T.read_files(spark, f"file://{tmp_path}/a", table, manifest).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want(odd.collect())
    first = tmp_path / "a" / names[-1]
    first.write_bytes(first.read_bytes()[:-4] + b"abcd")
    with pytest.raises(Exception, match="checksum|not all there"):
        T.read_files(spark, f"file://{tmp_path}/a", table, manifest).collect()
