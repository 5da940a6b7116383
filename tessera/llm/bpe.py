"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so a word may be cut between
its two bytes and the fragments encoded on their own. Fragments and words repeat, so each is encoded once
and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, texts

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Pre-tokenization of the vocabulary file, over lower-cased text.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Texts of these characters are in NFC, have simple lower case, and their white space is what str.split cuts at.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿŒœ–—‘’“”…€]*")
_PLAIN_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿœ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿœ]+")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Fragments up to this many bytes are merged side by side, row by row of a matrix; longer ones are merged on their own.
LONGEST_ROW = 32
#: Rows of one matrix, and characters of the texts whose words are encoded together.
ROWS, SLICE_CHARS = 20_000, 4_000_000


class _Pairs:
    """The merges as a hash table of arrays: for many pairs at once, rank << 20 and the id that comes out, or NONE."""

    NONE = 1 << 60
    _BITS = 18

    def __init__(self, merges: dict[tuple[int, int], int]):
        self.keys = np.full(1 << self._BITS, -1, dtype=np.int64)
        self.values = np.full(1 << self._BITS, self.NONE, dtype=np.int64)
        pairs = np.array(list(merges), dtype=np.int64).reshape(-1, 2)
        keys, values = pairs[:, 0] << 20 | pairs[:, 1], np.fromiter(merges.values(), dtype=np.int64, count=len(merges))
        at = self._hash(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = first[free[first]]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            left = np.ones(len(keys), dtype=bool)
            left[take] = False
            keys, values, at = keys[left], values[left], at[left] + 1 & len(self.keys) - 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = self._hash(keys)
        out = np.where(self.keys[at] == keys, self.values[at], self.NONE)
        due = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(due):
                break
            at[due] = at[due] + 1 & len(self.keys) - 1
            held = self.keys[at[due]]
            hit = held == keys[due]
            out[due[hit]] = self.values[at[due[hit]]]
            due = due[~hit & (held >= 0)]
        return out


class ForcedBoundaryBPE:
    """Encodes like the tokenizers library does with the same file, add_special_tokens=False, no truncation or padding."""

    def __init__(self, path: str, held: int = 1_000_000):
        """held: words kept with their ids, about 200 bytes each, over the tasks of a worker."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.token_of = {str(i): t for i, t in self.tokens.items()}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.suffix] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}  # rank, and in the low 20 bits the id that comes out
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]
        back = {c: b for b, c in letters.items()}
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            body = [back[c] for c in token.removesuffix(self.suffix)]
            self.joined[body[:-1], body[1:]] = True
        self._cut = (~self.joined).tobytes()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pairs = _Pairs(self.merges)
        self._inner, self._last = np.array(self.inner, dtype=np.int64), np.array(self.last, dtype=np.int64)
        self.held = held
        self._packed: dict[str, bytes] = {}
        self._decimal: dict[str, str] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every byte pair that no vocabulary token holds."""
        if len(word) < 2:
            return [word]
        cut = self._cut
        at = [i for i, (a, b) in enumerate(zip(word, word[1:]), 1) if cut[a << 8 | b]]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def _merge(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, 1 << 60
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i : i + 2] = [least & 0xFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As _merge, in n log n, for fragments of thousands of bytes."""
        import heapq

        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        get = self.merges.get
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            new, j = m & 0xFFFFF, after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get((new, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (m, i, new, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := get((ids[p], new))) is not None:
                heapq.heappush(heap, (m, p, ids[p], new))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]

    def _fragment(self, piece: bytes, last: bool) -> list[int]:
        ids = [self.inner[b] for b in piece]
        if last:
            ids[-1] = self.last[piece[-1]]
        return self._merge(ids) if len(ids) < 200 else self._merge_long(ids)

    def _rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row of ids, -1 behind its end, in place."""
        n = ids.shape[1]
        cols = np.arange(n)
        whole, where = ids, np.arange(len(ids))
        none = _Pairs.NONE
        ranks = np.full(ids.shape, none, dtype=np.int64)
        ranks[:, :-1] = self._pairs(ids[:, :-1].ravel(), np.maximum(ids[:, 1:], 0).ravel()).reshape(-1, n - 1)
        ranks[:, :-1][ids[:, 1:] < 0] = none
        while True:
            at = ranks.argmin(axis=1)
            row = np.arange(len(ids))
            best = ranks[row, at]
            going = best < none
            if not going.all():
                whole[where[~going]] = ids[~going]
                ids, ranks, where, at, best = ids[going], ranks[going], where[going], at[going], best[going]
                row = np.arange(len(ids))
            if not len(ids):
                return whole
            ids[row, at] = best & 0xFFFFF
            src = np.minimum(cols + (cols > at[:, None]), n - 1)
            ids = np.take_along_axis(ids, src, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), n - 1), axis=1)
            ranks[:, -1] = none
            for k in (at - 1, at):
                ok = np.flatnonzero((k >= 0) & (ids[row, np.minimum(k + 1, n - 1)] >= 0) & (k + 1 < n))
                k_ok = k[ok]
                ranks[ok, k_ok] = self._pairs(ids[ok, k_ok], ids[ok, k_ok + 1])
            ended = np.flatnonzero(ids[row, np.minimum(at + 1, n - 1)] < 0)
            ranks[ended, at[ended]] = none

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin and the last one's end.

        Words are cut at every byte pair that no vocabulary token holds, and the fragments are encoded on their own.
        """
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[0] = True
        cut[ends] = True
        start = np.flatnonzero(cut)[:-1]
        size = np.diff(np.flatnonzero(cut))
        symbol = self._inner[data]
        symbol[ends - 1] = self._last[data[ends - 1]]
        out = np.full(len(data), -1, dtype=np.int64)
        single = start[size == 1]
        out[single] = symbol[single]
        width = 2
        least = 2
        while least <= LONGEST_ROW:
            rows = np.flatnonzero((size >= least) & (size <= width))
            for i in range(0, len(rows), ROWS):
                r = rows[i : i + ROWS]
                at = start[r][:, None] + np.arange(width)
                inside = np.arange(width) < size[r][:, None]
                ids = np.where(inside, symbol[np.minimum(at, len(data) - 1)], -1)
                out[at[inside]] = self._rows(ids)[inside]
            least, width = width + 1, width * 2
        for k in np.flatnonzero(size > LONGEST_ROW).tolist():
            i, j = int(start[k]), int(start[k] + size[k])
            ids = self._fragment(data[i:j].astype(np.uint8).tobytes(), bool(symbol[j - 1] == self._last[data[j - 1]]))
            out[i : i + len(ids)] = ids
        used = out >= 0
        return out[used], np.concatenate(([0], np.cumsum(used)[ends - 1]))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learned(self, table: dict, chunks: list[list[str]], join, form) -> dict:
        """The value of every chunk of a slice: form() of its words' ids, joined; taken from the table, where new ones are kept."""
        own = set().union(*chunks)
        new = own.difference(table)
        if not new:
            return {c: table[c] for c in own}
        if len(table) + len(new) > self.held:
            table.clear()
            new = own
        single = [c for c in new if c.isalpha()]
        several = [(c, tuple(_PLAIN_WORDS.findall(c))) for c in new if not c.isalpha()]
        words = list(dict.fromkeys(chain(single, *(p for _, p in several))))
        ids, at = self.encode_words(words)
        values = dict(zip(words, form(ids, at.tolist()), strict=True))
        table.update((c, values[c]) for c in single)
        table.update((c, join(map(values.__getitem__, p))) for c, p in several)
        return {c: table[c] for c in own}

    def _batch(self, texts: list[str], table: dict, join, form, slow) -> Iterator:
        for some in self._slices(texts):
            chunks = [t.lower().split() if _PLAIN.fullmatch(t) and "<|" not in t else None for t in some]
            known = self._learned(table, [c for c in chunks if c], join, form).__getitem__
            for t, c in zip(some, chunks, strict=True):
                yield slow(self._slow(t)) if c is None else join(map(known, c))

    @staticmethod
    def _slices(texts: list[str]) -> Iterator[list[str]]:
        held, n = [], 0
        for t in texts:
            held.append(t)
            n += len(t)
            if n >= SLICE_CHARS:
                yield held
                held, n = [], 0
        if held:
            yield held

    @staticmethod
    def _packed_of(ids: np.ndarray, at: list[int]) -> list[bytes]:
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(at, at[1:])]

    @staticmethod
    def _decimal_of(ids: np.ndarray, at: list[int]) -> list[str]:
        told = list(map(str, ids.tolist()))
        return [" ".join(told[i:j]) for i, j in zip(at, at[1:])]

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        return self._batch(texts, self._packed, b"".join, self._packed_of, self._pack)

    def decimal(self, texts: list[str]) -> Iterator[str]:
        """Each text's ids in decimal, joined by one space."""
        return self._batch(texts, self._decimal, " ".join, self._decimal_of, lambda ids: " ".join(map(str, ids)))

    @staticmethod
    def words(text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.splitter and "<|" in text:
            for part in self.splitter.split(text):
                if part:
                    yield part in self.special, part
        elif text:
            yield False, text

    def encode(self, text: str) -> list[int]:
        packed = next(self.packed([text]))
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def _slow(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self._parts(text):
            words = [] if special else self.words(part)
            out += [self.special[part]] if special else self.encode_words(words)[0].tolist() if words else []
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_decimal(self, ids: str) -> str:
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One for each Python worker, as reading the vocabulary takes a second."""
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each whole text; a null or empty text has no ids. Ids repeat and may be null."""
    path = path or vocabulary_path()

    def run(batches):
        own = encoder(path)
        for b in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in own.packed(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the tokens of the ids joined by one space, as the vocabulary file names no decoder. Null ids: empty."""
    path = path or vocabulary_path()

    def run(batches):
        own = encoder(path)
        for b in batches:
            out = [own.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without moving the ids between processes.

    Null and empty texts have no ids; equal rows give equal rows; an empty table gives an empty one.
    """
    path = path or vocabulary_path()

    def run(batches):
        own = encoder(path)
        sha = hashlib.sha256
        for b in batches:
            n, ids, decoded = [], [], []
            for d in own.decimal(b.column("text").to_pylist()):
                n.append(d.count(" ") + 1 if d else 0)
                ids.append(sha(d.encode()).hexdigest())
                decoded.append(sha(own.decode_decimal(d).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
