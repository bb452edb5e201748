"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into machines over characters: the normaliser (its rewritings of characters
and spaces, longest match first), the lexicon (a trie of pieces, whose final states write a
piece's id at minus its score, or at nothing in merge models), byte fallback (an arc for each
character without a piece) and, for merge (BPE) models, a machine over neighbouring pieces: its
arc from piece a to piece b weighs 0 if merging the text of both gives just a and b, else
infinity.  A text's merge encoding is the one path of finite weight, since an encoding is the
merge result if each pair of neighbours is [see `pair`].

A text goes through the normaliser; what comes out is composed with the others as it is walked
through, and the encoding is the shortest path in the tropical semiring.  No piece has a word
mark after another character, so the composed machine is back in its first state at each word:
words are solved one by one and each worker keeps the answers.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_of, tidy

MARK = "▁"
WORDS_KEPT = 700_000
LONGEST_KEPT = 64  # characters of a word whose answer is kept
INF = float("inf")
_kept: dict[str, Transducer] = {}


class Machine:
    """A transducer over characters in the form of a trie: arcs by state; what a final state writes, and its weight."""

    def __init__(self, entries: dict[str, tuple[object, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list = [None]
        self.weight = [INF]
        for text, (out, weight) in entries.items():
            state = 0
            for c in text:
                to = self.arcs[state].get(c)
                if to is None:
                    to = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.out.append(None)
                    self.weight.append(INF)
                state = to
            self.out[state], self.weight[state] = out, weight
        # as a rewriting: characters at once if no source is longer, else the longest source at each place
        self.table = {ord(k): out for k, (out, _) in entries.items()} if all(len(k) == 1 for k in entries) else None
        alone = self.table is not None and len(entries) < 4 and not any(k in out for k in entries for out, _ in entries.values())
        self.few = [(k, out) for k, (out, _) in entries.items()] if alone else None
        self.first = None if self.table is not None else re.compile("[" + "".join(map(re.escape, self.arcs[0])) + "]") if entries else None

    def rewrite(self, text: str) -> str:
        """The text with each longest source replaced by what the machine writes for it."""
        if self.few is not None:
            for source, out in self.few:
                text = text.replace(source, out)
            return text
        if self.table is not None:
            return text.translate(self.table)
        out, at, arcs = [], 0, self.arcs
        for found in self.first.finditer(text):
            start = found.start()
            if start < at:
                continue
            state, end, best = 0, start, None
            while end < len(text) and (state := arcs[state].get(text[end], -1)) >= 0:
                end += 1
                if self.out[state] is not None:
                    best = end, self.out[state]
            if best:
                out += [text[at:start], best[1]]
                at = best[0]
        out.append(text[at:])
        return "".join(out)


def charsmap(blob: bytes) -> dict[str, str]:
    """Sources and replacements of a precompiled map: a double-array trie of UTF-8 and, after it, the replacements."""
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    labels = np.arange(1, 256)
    offset = lambda u: (int(u) >> 10) << ((int(u) & 0x200) >> 6)
    out, todo = {}, [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        children = at ^ labels
        children, own = children[children < len(units)], labels[children < len(units)]
        for label, child in zip(own[(units[children] & 0x800000FF) == own].tolist(), children[(units[children] & 0x800000FF) == own].tolist()):
            unit, name = units[child], key + bytes([label])
            to = child ^ offset(unit)
            if int(unit) >> 8 & 1:
                place = int(units[to]) & 0x7FFFFFFF
                out[name.decode()] = texts[place : texts.index(b"\0", place)].decode()
            todo.append((to, name))
    return out


class Transducer:
    """The machines of one model file (or its bytes)."""

    def __init__(self, model_file: str | bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if isinstance(model_file, bytes):
            model.ParseFromString(model_file)
        else:
            with open(model_file, "rb") as f:
                model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces or model.trainer_spec.model_type not in (1, 2) or any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("only unigram and merge models with word marks in front and no pieces of the user's own are compiled")
        self.front, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        rules = charsmap(spec.precompiled_charsmap) if spec.precompiled_charsmap else {}
        self.normaliser = Machine({k: (v.replace(" ", MARK), 0.0) for k, v in ({" ": MARK} | rules).items()})
        self.names = [p.piece for p in model.pieces]
        self.piece = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = [p.score for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), 0)
        self.merges = model.trainer_spec.model_type == 2
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece goes on after a word mark")
        self.beside = {x for p in self.piece for x in zip(p, p[1:])}
        self.alone = {c for c in ("\n", "\t") if self.byte_id and not any(c in x for x in self.beside)}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        if self.merges:
            self._order()
            self.lexicon = Machine({p: (r, 0.0) for p, r in self.rank.items()})
        else:
            self.id = list(range(len(self.names)))
            self.lexicon = Machine({p: (i, -self.score[i]) for p, i in self.piece.items()})
        # a character without a piece costs more than any piece
        self.fallback = 0.0 if self.merges else 10.0 - min([self.score[i] for i in self.piece.values()] or [0.0])
        self.cutter = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merging by itself, to find which pieces it makes: again and again the best-scored neighbours, leftmost first."""
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and (k := self.piece.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, symbols[i] + symbols[j]))

        symbols = list(symbols)
        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            right[i] = right[j]
            if right[i] < len(symbols):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s]

    def _order(self) -> None:
        """Pieces in the order in which merging makes them, single characters first, and their halves."""
        base = sorted(p for p in self.piece if len(p) == 1)
        made = sorted((p for p in self.piece if len(p) > 1), key=lambda p: (-self.score[self.piece[p]], self.piece[p]))
        whole = [p for p in made if self._merge(list(p)) == [p]]  # others never come out of merging
        self.rank = {p: r for r, p in enumerate([*base, *whole])}
        self.text = [*base, *whole]
        self.id = [self.piece[p] for p in self.text]
        self.halves = [(r, r) for r in range(len(base))]
        for r, p in enumerate(whole, len(base)):
            cut = next(i for i in range(1, len(p)) if self._last_merge(p, i, r))
            self.halves.append((self.rank[p[:cut]], self.rank[p[cut:]]))

    def _last_merge(self, p: str, cut: int, r: int) -> bool:
        a, b = self.rank.get(p[:cut]), self.rank.get(p[cut:])
        return a is not None and b is not None and a < r and b < r and self.pair(a, b, r)

    def pair(self, a: int, b: int, before: int | None = None) -> bool:
        """Do pieces a and b stay apart when their texts are merged together (but for merges from `before` on)?

        Merges are undone from the last: if the two that touch at some time would have merged
        before the next one undone was made, the pair isn't a result of merging.
        """
        limit = before if before is not None else len(self.text)
        while True:
            both = self.rank.get(self.text[a] + self.text[b])
            if both is not None and both < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def _bytes(self, c: str) -> list[int]:
        """What the fallback machine writes for a character."""
        return [self.byte_id[b] for b in c.encode("utf-8", "replace")] if self.byte_id else [self.unknown]

    def shortest(self, word: str) -> list[int]:
        """Ids along the tropical shortest path through a normalised word composed with lexicon, fallback and pairs.

        A state of the composition is a place in the word and, in merge models, the piece before
        it; of those at one place at most one is at a finite distance, so one is kept for each.
        Of equal paths the first found, whose last piece is the longest, stays.
        """
        n, arcs, out, weight, pairs, merges = len(word), self.lexicon.arcs, self.lexicon.out, self.lexicon.weight, self.pairs, self.merges
        dist, came, last = [0.0, *[INF] * n], [0] * (n + 1), [-1] * (n + 1)  # last -1: nothing, or bytes
        root = arcs[0]
        for start in range(n):
            d = dist[start]
            if d == INF:
                continue
            state = root.get(word[start])
            if state is None or out[state] is None:  # no piece for the character itself
                if d + self.fallback < dist[start + 1]:
                    dist[start + 1], came[start + 1], last[start + 1] = d + self.fallback, start, -1
            a, end = last[start], start + 1
            while state is not None:
                b = out[state]
                if b is not None and d + weight[state] < dist[end]:
                    if merges and a >= 0:
                        key = a << 20 | b
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = self.pair(a, b)
                    else:
                        ok = True
                    if ok:
                        dist[end], came[end], last[end] = d + weight[state], start, b
                if end == n:
                    break
                state = arcs[state].get(word[end])
                end += 1
        ids, end = [], n
        while end:
            if last[end] < 0:
                ids += self._bytes(word[end - 1])[::-1]
            else:
                ids.append(self.id[last[end]])
            end = came[end]
        ids.reverse()
        return ids if self.byte_id else self._joined(ids)

    def _joined(self, ids: list[int]) -> list[int]:
        """Unknown characters in a row are one."""
        return [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != self.unknown]

    def _word(self, word: str) -> bytes:
        """Ids of a word with its marks in front; parts that no piece can span are kept by themselves."""
        beside, known, out, at = self.beside, self.words, [], 0
        cuts = [i for i, x in enumerate(zip(word, word[1:]), 1) if x not in beside] if self.byte_id else []
        for i in [*cuts, len(word)]:
            part = word[at:i]
            at = i
            ids = known.get(part)
            if ids is None:
                got = self.shortest(part)
                ids = struct.pack(f"<{len(got)}I", *got)
                if len(part) <= LONGEST_KEPT:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def normalise(self, text: str) -> str:
        """What the normaliser writes: rewritten characters, spaces squeezed if the model says so, a mark in front."""
        out = self.normaliser.rewrite(text)
        if self.squeeze:
            out = re.sub(f"{MARK}{MARK}+", MARK, out).strip(MARK)
        return MARK + out if self.front and out else out

    def plain(self, text: str) -> str:
        """The text that decoding gives back: the normalised one with spaces for marks."""
        out = self.normalise(text).replace(MARK, " ")
        return out[1:] if self.front and out else out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        known, out = self.words, []
        if len(known) > WORDS_KEPT:
            self.words = known = dict(islice(known.items(), WORDS_KEPT // 4))
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        for text in texts:
            plain = self.normalise(text)
            if MARK * 2 in plain or "\0" in plain:
                parts = self.cutter.findall(plain)
                for c in self.alone:
                    parts = [x for w in parts for x in ([w] if c not in w else _around(w, c))]
            else:  # the same, where each word has one mark
                plain = plain.replace(MARK, "\0" + MARK)
                for c in self.alone:
                    plain = plain.replace(c, f"\0{c}\0")
                parts = list(filter(None, plain.split("\0")))
            got = list(map(known.get, parts))
            if None in got:
                for k, x in enumerate(got):
                    if x is None:
                        w = parts[k]
                        got[k] = known.get(w) or self._word(w)
                        if len(w) <= LONGEST_KEPT:
                            known[w] = got[k]
            out.append(np.frombuffer(b"".join(got), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, marks turned into spaces."""
        if not hasattr(self, "raw"):
            self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b" \xe2\x81\x87 " if i == self.unknown else p.encode() for i, p in enumerate(self.names)]
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.front and text.startswith(" ") else text


def _around(word: str, c: str) -> list[str]:
    """A word cut before and after each c."""
    return [x for x in re.split(f"({c})", word) if x]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back.

    Returns doc_id, n_tokens, ids (array), ids_crc32 (of the ids as little-endian u32) and exact
    (the decoded text is the normalised one with spaces for word marks).
    A null or empty text has no ids; a very long one is encoded whole.  Rows stay apart, equal ones too.  Of an empty table the
    result is empty.  Other columns are not looked at.
    """
    path = path or default_model()

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machine = Transducer.of(path)
        for b in batches(it, rows=256):
            texts = b.column(1).to_pylist()
            ids = machine.encode(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            exact = [machine.decode(x) == machine.plain(t) for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(exact)],
                names=["doc_id", "n_tokens", "ids", "ids_crc32", "exact"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, exact boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of encode_documents' ids; null ids give the empty text."""
    path = path or default_model()

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machine = Transducer.of(path)
        for b in it:
            texts = [machine.decode(np.array(x or [], np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
