"""Byte-pair encoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can never end up in one token, whatever is
merged first: between them lies a certain cut. Words are cut there, each fragment is merged by itself, and the ids are
put on end. What a worker has coded it keeps, within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

CACHE_CHUNKS = 200_000
CACHE_WORDS = 200_000
LONG = 64
#: Letters, then marks without an apostrophe: the split pattern parts them so, and only lower case changes them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿß]+)([!-&(-/:-@\[-`{-~]*)")
_SPACES = regex.compile(r"\p{White_Space}+")
_CODERS: dict[str, ForcedBoundaryBPE] = {}


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else one from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = itertools.count(0x100)
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encodes and decodes as the tokenizers file says: added tokens, normaliser, split pattern, byte level, merges with a word-end mark."""

    def __init__(self, name: str):
        with open(tokens.vocabulary(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.written = {i: t.encode() for i, t in self.tokens.items()}
        self.shown = {i: str(i).encode() for i in self.tokens}
        self.kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self._index()
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _index(self) -> None:
        """Symbols as numbers: byte b inside a word is b, as its last symbol 256 + b; merged pairs follow by rank."""
        alphabet = byte_alphabet()
        self.first_ids = [self.vocab[c] for c in alphabet] + [self.vocab[c + self.suffix] for c in alphabet]
        start = {i: s for s, i in reversed(list(enumerate(self.first_ids)))}  # an id's symbol; without a suffix both are one
        number = {t: start.get(i, 512 + i) for t, i in self.vocab.items()}
        self.id_of = {n: self.vocab[t] for t, n in number.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for (a, b), r in self.ranks.items():
            self.rank[number[a] << 20 | number[b]] = r
            self.made.append(number[a + b])
        byte = {c: b for b, c in enumerate(alphabet)}
        #: Symbols that stand side by side in some token.
        self.beside = bytearray(512 * 512)
        for t in self.vocab:
            s = self.symbols(t)
            n = [byte[c] for c in s[:-1]] + [byte[s[-1][0]] + 256 * (len(s[-1]) > 1)]
            for a, b in itertools.pairwise(n):
                self.beside[a << 9 | b] = 1

    def symbols(self, token: str) -> list[str]:
        """A token's characters; the word-end mark belongs to the last of them."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def cuts(self, word: list[int]) -> list[list[int]]:
        """The word's symbols parted where no token can reach across."""
        out, at, beside = [], 0, self.beside
        for i in range(1, len(word)):
            if not beside[word[i - 1] << 9 | word[i]]:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def merge(self, sym: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals; the ids."""
        if len(sym) > 40:
            return self._merge_long(sym)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(a << 20 | b, none) for a, b in itertools.pairwise(sym)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            sym[i] = m = made[low]
            del sym[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(sym[i - 1] << 20 | m, none)
            if i < len(ranks):
                ranks[i] = rank(m << 20 | sym[i + 1], none)
        return [self.id_of[s] for s in sym]

    def _merge_long(self, part: list[int]) -> list[int]:
        """The same over linked symbols with a heap, near linear in the fragment."""
        sym: list[int] = list(part)
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(itertools.pairwise(part)) if (r := self.rank.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = self.made[r], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (x := self.rank.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (x, i, sym[i], sym[k]))
            if (h := left[i]) >= 0 and (x := self.rank.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, (x, h, sym[h], sym[i]))
        return [self.id_of[s] for s in sym if s >= 0]

    def word_ids(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            symbols = list(word.encode("utf-8"))
            symbols[-1] += 256
            got = []
            for part in self.cuts(symbols):
                got += self.merge(part)
            if len(word) <= LONG:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def normalise(self, text: str) -> str:
        for kind in self.kinds:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = _SPACES.sub(" ", text)
            elif kind == "Lowercase":
                text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        return text

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.specials.split(text) if self.specials and "<|" in text else [text]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word in self.split.findall(self.normalise(part)):
                    ids += self.word_ids(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them, as the file names no decoder; unknown ids are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        m = _PLAIN.fullmatch(chunk)
        ids = self.word_ids(m[1].lower()) + (self.word_ids(m[2]) if m[2] else []) if m else self.encode(chunk)
        return b" ".join([self.shown[i] for i in ids]), b" ".join([self.written[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text) of a whole text.

        No pre-token holds a space or a line break, so the chunks between them are coded by themselves (and kept, within
        a bound) and their ids and decoded texts put on end.
        """
        known = self.chunks
        if len(known) > CACHE_CHUNKS:
            self.older, self.chunks = known, {}
            known = self.chunks
        ids, decoded = [], []
        for c in tokens.chunks_of(text):
            got = known.get(c)
            if got is None:
                got = self.older.get(c) or self._chunk(c)
                if len(c) <= LONG:
                    known[c] = got
            if got[0]:
                ids.append(got[0])
                decoded.append(got[1])
        joined = b" ".join(ids)
        return joined.count(b" ") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()


def coder(name: str) -> ForcedBoundaryBPE:
    if name not in _CODERS:
        _CODERS[name] = ForcedBoundaryBPE(name)
    return _CODERS[name]


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row. Null text is empty: no ids, digests of nothing. Very long texts are encoded whole. Repeated rows stay; extra columns are left behind; an empty table has no rows."""

    def run(batches):
        bpe = coder(tokenizer)
        for b in batches:
            rows = [bpe.digests(t) for t in common.texts(b.column(1))]
            n, ids, decoded = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with word_bpe_49k by forced-boundary splitting, then decoded."""
    return round_trip(common.table(spark, sf_dir, "documents"), "word_bpe_49k.json")
